"""Case logs as a stream: the current status of each case, whatever the order in which its events arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tally.operators.cases import _apply
from tally.storage import new_path, written

#: An event of a case's log; ``seq`` counts from 1 without gaps.
EVENT = "case_id string, seq int, kind string, actor_id string, role string, assignee_id string"
#: What is known of a case: its state after the events up to ``last_seq``, and how many later ones wait for one that is missing.
STATUS = "case_id string, status string, assignee_id string, requester_id string, applied int, refused int, first_refused int, reason string, last_seq int, waiting int"
_STATE = "status string, assignee_id string, requester_id string, applied int, refused int, first_refused int, reason string, last_seq int, waiting int, early string"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")][:-1]


class CaseStatus(StatefulProcessor):
    """Keeps a case's state and the events that came before one they must follow.

    An event that was applied already, or waits already, changes nothing, so a
    replayed batch is harmless. The state holds no log: an event goes once all
    before it are there. What waits is a part of the case's one value, as text:
    a call to the store for each event would take most of the time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.case = handle.getValueState("case", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.case.get() if self.case.exists() else ("open", None, None, 0, 0, None, None, 0, 0, None)
        s = dict(zip(_FIELDS, known))
        last, waiting = s.pop("last_seq"), s.pop("waiting")
        early = {seq: event for seq, *event in json.loads(known[-1])} if waiting else {}
        for batch in rows:
            for seq, *event in batch[["seq", "kind", "actor_id", "role", "assignee_id"]].sort_values("seq", kind="stable").itertuples(index=False, name=None):
                seq, event = int(seq), [None if pd.isna(x) else x for x in event]
                if seq <= last:
                    continue
                if seq > last + 1:
                    if seq not in early:
                        early[seq] = event
                    continue
                _apply(s, seq, *event)
                last = seq
                while last + 1 in early:
                    last += 1
                    _apply(s, last, *early.pop(last))
        state = (*s.values(), last, len(early))
        self.case.update((*state, json.dumps([(seq, *event) for seq, event in early.items()]) if early else None))
        yield pd.DataFrame([(key[0], *state)], columns=["case_id", *_FIELDS], dtype=object)

    def close(self) -> None:
        pass


def current_status(events: DataFrame) -> DataFrame:
    """STATUS rows of a stream of EVENT rows, one for each case that a batch touches; needs the RocksDB state store.

    Events without a case or a seq are left out: they have no place in a log.
    """
    rows = events.where("case_id is not null and seq is not null").select("case_id", "seq", "kind", "actor_id", "role", "assignee_id")
    return rows.groupBy("case_id").transformWithStateInPandas(CaseStatus(), STATUS, "update", "none")


#: The state store that keeps several states of a key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(events: DataFrame, table: str, checkpoint: str) -> None:
    """Reads what a stream of events holds now into Parquet files of the folder ``table``, one folder a batch; a batch that is run again replaces its own."""
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        current_status(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last known STATUS row of each case in a folder of :func:`run_to_table`."""
    newest = Window.partitionBy("case_id").orderBy(F.desc("batch"))
    rows = spark.read.schema(STATUS + ", batch long").parquet(table)
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "batch")


#: Files of a batch.
FILES = 16


def replay_stream(log: DataFrame, batches: int, order: str) -> DataFrame:
    """STATUS of every case of a finished log that is streamed in ``batches`` files, dealt by the expression ``order``."""
    spark = log.sparkSession
    source, table, checkpoint = (new_path(spark, f"case-{x}") for x in ("log", "status", "checkpoint"))
    dealt = log.select("case_id", F.col("seq").cast("int").alias("seq"), "kind", "actor_id", "role", "assignee_id", F.pmod(F.expr(order), F.lit(batches)).cast("int").alias("part"))
    dealt = written(dealt, "case-dealt")
    for k in range(batches):
        part = dealt.where(F.col("part") == k).drop("part")
        # As many files each, of which none is empty, as long as there are enough rows; a stream takes them in the order in which they were written.
        part.repartition(FILES).write.mode("append").parquet(f"{source}/{k}")
    run_to_table(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", FILES).parquet(f"{source}/*"), table, checkpoint)
    return latest(spark, table)
