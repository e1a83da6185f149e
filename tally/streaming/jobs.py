"""Streaming forms: incremental ingest, token bucket, scheduled anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tally.operators import audit
from tally.schemas import AUDIT, TRANSACTION
from tally.sources import statements as st


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows under ``folder``, none where nothing was written there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


#: A stored transaction of a source's folder, with the batch that brought it.
_STORED = ", ".join(c for c in TRANSACTION.split(", ") if not c.startswith("source_id ")) + ", batch long"


def ingest_batch(table: str, parse, tenant_id: str, source_id: str, currency: str):
    """A foreachBatch function that adds statement files to ``table``/source_id=.../batch=...

    A batch reads the references of its own source only, and of earlier
    batches only; a batch that runs again replaces what it had written, so
    every file counts once. Rows whose reference is stored already or repeats
    within the batch are left out with all rows of their file.
    """
    folder = f"{table.rstrip('/')}/source_id={source_id}"

    def put(batch: DataFrame, number: int) -> None:
        accepted, _rejects = st.gate(parse(batch.select("path", "content")))
        keyed = accepted.withColumn("source_id", F.lit(source_id))
        have = _stored(batch.sparkSession, folder, _STORED).where(F.col("batch") < number).select("external_ref").distinct()
        repeated = keyed.groupBy("external_ref").agg(F.count("*").alias("n")).where("n > 1").select("external_ref")
        known = keyed.select("external_ref").join(have, "external_ref", "left_semi")
        bad = keyed.join(repeated.unionByName(known).distinct(), "external_ref", "left_semi").select("path").distinct()
        st.canonical(keyed.join(bad, "path", "left_anti"), tenant_id, source_id, currency).drop("source_id").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return put


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, parse, tenant_id: str, source_id: str, currency: str):
    """Statement files that arrive in ``folder`` become rows of ``table`` by :func:`ingest_batch`. Returns the started query."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    put = ingest_batch(table, parse, tenant_id, source_id, currency)
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(rows: pd.DataFrame, tokens: float, last: float | None, capacity: float, refill: float) -> tuple[list[bool], float, float | None]:
    out = []
    for at in rows["at"]:
        now = at.timestamp()
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, now - last) * refill)
        last = now
        ok = tokens >= 1
        tokens -= ok
        out.append(bool(ok))
    return out, tokens, last


def token_bucket(requests: DataFrame, capacity: float = 10, refill: float = 10 / 60, delay: str = "1 hour") -> DataFrame:
    """(key, at, id, allowed) of a stream of requests (key, at, id): a bucket per key that refills by the second.

    A bucket that had time to fill up is like a new one, so the state of an
    idle key goes once the watermark, ``delay`` behind the latest request, has
    passed that time; requests that come later than ``delay`` are not judged.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for b in batches:
            b = b.sort_values(["at", "id"], kind="stable")
            allowed, tokens, last = _bucket(b, tokens, last, capacity, refill)
            yield b.assign(allowed=allowed)[["key", "at", "id", "allowed"]]
        state.update((tokens, last))
        full = int((last + (capacity - tokens) / refill) * 1000) + 1
        state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))

    kept = requests.withWatermark("at", delay)
    return kept.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket_batch(requests: DataFrame, capacity: float = 10, refill: float = 10 / 60) -> DataFrame:
    """The same for a finished table, streamed through each task in key and time order. A null key has a bucket too."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = object(), capacity, None
        for b in batches:
            out = []
            for k, part in b.groupby("key", sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if k != key:
                    key, tokens, last = k, capacity, None
                allowed, tokens, last = _bucket(part, tokens, last, capacity, refill)
                out.append(part.assign(allowed=allowed)[["key", "at", "id", "allowed"]])
            if out:
                yield pd.concat(out)

    return requests.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(fold, "key string, at timestamp, id bigint, allowed boolean")


_ANCHOR = "anchor_seq bigint, at string, tenant_heads map<string, struct<hash: string, seq: bigint>>, prev_hash binary, hash binary"


def anchor_batch(log_path: str, anchors_path: str):
    """A foreachBatch function that anchors the heads of a log once a trigger.

    ``log_path`` holds entries in folders batch=..., those of the writers under
    -1. A trigger's anchor and the entries that tell of it go into folders of
    its own number: run again after a failure it reads what earlier ones left
    and replaces its own, so it adds nothing twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = batch.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
        if at is None:
            return
        log = _stored(spark, log_path, f"{AUDIT}, batch long").where(F.col("batch") < number).drop("batch")
        anchors = _stored(spark, anchors_path, f"{_ANCHOR}, batch long").where(F.col("batch") < number).drop("batch")
        row, told = audit.anchor_now(log, anchors, at)
        told.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        row.write.mode("overwrite").parquet(f"{anchors_path}/batch={number}")

    return put


def anchor_stream(spark: SparkSession, log_path: str, anchors_path: str, checkpoint: str, every: str = "1 hour"):
    """The anchors of a log at a fixed pace, the first after one interval. Returns the started query."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 1000).load()
    return ticks.writeStream.foreachBatch(anchor_batch(log_path, anchors_path)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
