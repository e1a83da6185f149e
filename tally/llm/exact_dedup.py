"""Exact dedup by a cuckoo-filter index over digests of the normalised text.

The index is a bucketed table of live digests with a cuckoo filter in front of
each bucket: a lookup that misses proves a digest new, a hit is verified
against the stored contents, and an insertion that finds no room makes the
filter larger and refills it from the bucket's keys. Digests can be inserted
and deleted batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, id_key, keep_rows, materialise, spread_join

SLOTS = 4
#: Digests of a bucket, about: bounds the filter and the keys that a task holds.
BUCKET_KEYS = 100_000


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; partial-key cuckoo hashing."""

    def __init__(self, capacity: int = 64, max_kicks: int = 64):
        self.n = 1 << max(2, (int(capacity * 1.1) // SLOTS).bit_length())
        self.max_kicks = max_kicks
        self.slots = [[] for _ in range(self.n)]

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        i = int.from_bytes(key[:8], "little") & (self.n - 1)
        return mark, i, self._other(i, mark)

    def __contains__(self, key: bytes) -> bool:
        mark, i, j = self._places(key)
        return mark in self.slots[i] or mark in self.slots[j]

    def insert(self, key: bytes) -> bool:
        """False when there is no room; the filter must then be rebuilt larger."""
        mark, i, j = self._places(key)
        for k in (i, j):
            if len(self.slots[k]) < SLOTS:
                self.slots[k].append(mark)
                return True
        k = i
        for turn in range(self.max_kicks):
            out = turn % SLOTS
            mark, self.slots[k][out] = self.slots[k][out], mark
            k = self._other(k, mark)
            if len(self.slots[k]) < SLOTS:
                self.slots[k].append(mark)
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, i, j = self._places(key)
        for k in (i, j):
            if mark in self.slots[k]:
                self.slots[k].remove(mark)
                return True
        return False


class CuckooIndex:
    """The keys of one bucket behind a cuckoo filter; a filter without room is made larger and refilled from the keys.

    ``meets`` only says that a key may be here: the bucket's contents decide.
    """

    def __init__(self, capacity: int = 64):
        self.capacity = capacity
        self.filter = CuckooFilter(capacity)
        self.keys: set[bytes] = set()
        self.resizes = 0

    def meets(self, key: bytes) -> bool:
        return key in self.filter

    def put(self, key: bytes) -> None:
        self.keys.add(key)
        if not self.filter.insert(key):
            self._grow()

    def remove(self, key: bytes) -> bool:
        """Deletes a key that is here; a key of another text with the same fingerprint stays."""
        if not self.meets(key) or key not in self.keys:
            return False
        self.keys.discard(key)
        return self.filter.delete(key)

    def _grow(self) -> None:
        while True:
            self.capacity = max(2 * self.capacity, 2 * len(self.keys))
            self.resizes += 1
            fresh = CuckooFilter(self.capacity)
            if all(fresh.insert(k) for k in self.keys):
                self.filter = fresh
                return


def normalised_digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own_id, id, row_key, digest) for every row; a null id gets the smallest key."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, key, row, texts = b.columns
            d = pa.array([normalised_digest(t.as_py()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, key, row, d], names=["own_id", "id", "row_key", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_batch, "own_id long, id long, row_key long, digest binary")


def _combine(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Before the shuffle: one row per digest and task, so that a huge group is small."""
    have: dict[bytes, list] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame([(k, *v) for k, v in have.items()], columns=["digest", "keep", "at", "group_size"])

    for b in batches:
        for i, at, d in zip(b["id"], b["at"], b["digest"]):
            d = bytes(d)
            e = have.get(d)
            if e is None:
                have[d] = [i, at, 1]
            else:
                e[2] += 1
                if (i, at) > (e[0], e[1]):
                    e[0], e[1] = i, at
        if len(have) > most:
            yield out()
            have.clear()
    if have:
        yield out()


class DigestIndex:
    """A cuckoo-filter index of live digests, kept as a table in a shared folder.

    The table (bucket, digest, keep, at, group_size) holds a row per live
    digest, ``keep`` the id that stays and ``at`` its row; ``bucket`` deals them into parts of about BUCKET_KEYS digests. ``insert``
    and ``delete`` stream each bucket's stored digests, then the given ones,
    through a filter of its own. A digest that meets nothing is new, without a
    look at the contents; those that meet something are verified against the
    contents of the table by an exact join, and false hits end there. Both
    write the table anew, so a lost executor costs only a task's retry.
    """

    SCHEMA = "bucket int, digest binary, keep long, at long, group_size long"

    def __init__(self, spark: SparkSession, expected: int = 1_000_000):
        self.buckets = max(1, -(-expected // BUCKET_KEYS))
        self.table = spark.createDataFrame([], self.SCHEMA)

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))

    def _hits(self, given: DataFrame, delete: bool) -> DataFrame:
        """(digest): the given (bucket, digest) rows that meet a stored or earlier given one in the filter; each digest once."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, of = CuckooIndex(), None
            for b in batches:
                met = []
                for bucket, is_given, key in zip(b["bucket"], b["given"], b["digest"]):
                    if bucket != of:
                        index, of = CuckooIndex(), bucket
                    key = bytes(key)
                    if delete and is_given:
                        if index.remove(key):
                            met.append(key)
                    elif is_given and index.meets(key):
                        met.append(key)
                    else:
                        index.put(key)
                yield pd.DataFrame({"digest": met})

        rows = self.table.select("bucket", F.lit(False).alias("given"), "digest").unionByName(given.select("bucket", F.lit(True).alias("given"), "digest"))
        return materialise(rows.repartition("bucket").sortWithinPartitions("bucket", "given").mapInPandas(run, "digest binary").distinct(), "digest-hits")

    def insert(self, hashed: DataFrame) -> DataFrame:
        """Adds (id, at, digest) rows; returns a written table (digest, keep, at, group_size, is_new) of the digests that were
        met: held by several of the rows, or live before (is_new false)."""
        combined = hashed.select("id", "at", "digest").mapInPandas(_combine, "digest binary, keep long, at long, group_size long")
        given = materialise(self._bucket(combined).select(*self.table.columns), "digest-batch")
        # Rows that a task has combined already have met each other.
        hits = self._hits(given, delete=False).unionByName(given.where("group_size > 1").select("digest")).distinct()
        hits = materialise(hits, "digest-hits")
        both = self.table.withColumn("old", F.lit(True)).unionByName(given.withColumn("old", F.lit(False)))
        content = both.join(hits, "digest", "left_semi").groupBy("bucket", "digest").agg(F.max(F.struct("keep", "at")).alias("top"), F.sum("group_size").alias("group_size"), F.max("old").alias("old"), F.min("old").alias("all_old"))
        met = materialise(content.select("bucket", "digest", "top.*", "group_size", "old", "all_old"), "digest-groups")
        rest = both.join(hits, "digest", "left_anti").drop("old")
        self.table = materialise(rest.unionByName(met.drop("old", "all_old")), "digest-index")
        return met.where("group_size > 1 and not all_old").select("digest", "keep", "at", "group_size", (~F.col("old")).alias("is_new"))

    def delete(self, gone: DataFrame) -> None:
        """Takes the given digests out of the index."""
        hits = self._hits(self._bucket(gone.select("digest").distinct()), delete=True)
        self.table = materialise(self.table.join(hits, "digest", "left_anti"), "digest-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, id, row_key): one row per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. All digests go into an empty index; those that meet none there are
    single, the others' groups are what the index says. Of a group the row
    with the largest id stays; a null id is smaller than any other. Where
    whole rows repeat, one of the repeats stays. A very long text is hashed whole. An empty table gives an empty result; other columns
    are not read.
    """
    hashed = materialise(digests(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id()), "digests")
    groups = DigestIndex(docs.sparkSession, hashed.count()).insert(hashed).drop("is_new").withColumnRenamed("at", "top_at")
    j = spread_join(hashed, groups, ["digest"], "group_size", "left")
    keep = F.coalesce("keep", "id")
    return j.select(
        F.col("own_id").alias(id_col),
        F.when(keep != NULL_ID, keep).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("top_at", "at") == F.col("at")).alias("kept"),
        "digest",
        "id",
        "row_key",
    )


def exact_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest id, all columns unchanged.

    Null and empty texts are one group; a null id is below all others. Of
    repeated rows one stays. Texts of any length are compared whole; columns
    of any other name go through as they are; an empty table gives no rows.
    """
    kept = exact_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).where("kept")
    return keep_rows(docs, kept.select("id", "row_key", F.lit(True).alias("single")), id_col, text_col)
