"""Line dedup with DataFrame functions only.

Hashes of long lines are range-partitioned with a secondary sort by document
and position, so that the first occurrence of each line streams past first;
the result is a compressed keep bitmap per document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import ascii_lower, id_key, materialise, trim_ascii

#: Lines of one key that a task streams, about: a line may be a third of all.
LINES_A_PART = 100_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document that loses lines: (id_key, row_key, n_dropped, runs).

    ``runs`` is the keep bitmap of the document's lines, run-length compressed:
    where each dropped run starts and stops; all other lines are kept. A line's key is the line without ASCII white space at
    its ends, A-Z lower-cased; a key of at least ``min_chars`` code points that
    at least ``min_docs`` documents hold is dropped everywhere but in the
    document with the largest id.

    Null or empty text is one empty line, which is never dropped. A null id
    counts as one document with the smallest id. Rows are told apart by id and
    text: repeated rows get the same bitmap and count as one document. Time is
    in proportion to a text's lines, however many there are or go; an empty
    table gives no bitmaps. Columns besides the two named are not read.
    """
    key = ascii_lower(trim_ascii(F.col("line")))
    # The hash of the text comes first: behind the lines it would be taken anew for each of them.
    keyed = docs.select(id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), _lines(text_col).alias("lines"))
    lines = keyed.select("id", "row_key", F.posexplode("lines").alias("pos", "line"))
    seen = (
        lines.where(F.char_length(trim_ascii(F.col("line"))) >= min_chars)
        .withColumn("key", key)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            "id", "row_key", "pos",
        )
    )
    seen = materialise(seen, "line-keys")
    # A line that a third of all documents share is spread over the salts, the more the larger the table.
    salts = 1 + seen.count() // LINES_A_PART
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    group = ["h1", "h2", "salt"]
    dealt = seen.select(*group, "id", "pos").repartitionByRange(*group).sortWithinPartitions(*group, F.desc("id"), "pos")
    stream = Window.partitionBy(*group).orderBy(F.desc("id"))
    first = dealt.withColumn("prev", F.lag("id").over(stream)).withColumn("new", F.col("prev").isNull() | (F.col("prev") != F.col("id")))
    per_salt = first.groupBy(*group).agg(F.count_if("new").alias("n"), F.max("id").alias("top"))
    whole = Window.partitionBy("h1", "h2")
    verdict = per_salt.select(*group, F.sum("n").over(whole).alias("n_docs"), F.max("top").over(whole).alias("keeper")).where(F.col("n_docs") >= min_docs)
    gone = seen.join(verdict, group).where(F.col("id") != F.col("keeper"))
    at = gone.groupBy("id", "row_key").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    ends = at.select(
        "id", "row_key", "at",
        F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1)).alias("starts"),
        F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1)).alias("ends"),
    )
    # Zipped, for an array that a lambda indexes may be made anew for each element.
    runs = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), (e + 1).alias("stop")))
    return ends.select("id", "row_key", F.size("at").cast("long").alias("n_dropped"), runs.alias("runs"))


def dropped_positions(runs: Column) -> Column:
    """The positions that a bitmap of :func:`line_bitmaps` drops."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["stop"] - 1)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its lines counted and its dropped lines gone: (id_col, n_lines, n_dropped, kept_text)."""
    d = docs.select(F.col(id_col).alias("own"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    lines = F.split("body", "\n", -1)
    j = d.join(bitmaps, ["id", "row_key"], "left").withColumn("lines", lines).withColumn("drop", F.when(F.col("n_dropped") > 0, dropped_positions(F.col("runs"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    rest = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return j.select(
        F.col("own").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("body")).otherwise(rest).alias("kept_text"),
    )
