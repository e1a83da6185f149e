"""Source divergence audit by ranking count cells.

How far each source of a language departs from the language and from its
other sources, by the smoothed shares of the terms that the language uses.
Terms of a source with equal counts there and in the language have equal
shares, so they form a cell that is judged once: cells are ranked by their
value and their multiplicity, cells of equal value become one, and only the
cells that reach into the report are expanded to terms again, in UTF-8 order.
All arithmetic is on whole numbers and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import materialise

#: Shares are parts of this unit; every count is taken as larger by SMOOTH.
UNIT, SMOOTH = 1_000_000_000, 5
#: Bytes of text counted at once, about; a longer text is counted piece by piece.
SLICE = 6 << 20
#: Sources and terms of a tile of the comparison of pairs, about.
TILE_SOURCES, TILE_TERMS = 64, 4096

#: Letters of ASCII in lower case, bytes of other characters as they are, all else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _long_text(text: memoryview) -> Counter:
    """Terms of one very long text, counted piece by piece; no piece ends inside a term."""
    found, at, end = Counter(), 0, len(text)
    carry = b""
    while at < end:
        piece = carry + bytes(text[at : at + SLICE]).translate(_TERMS)
        at += SLICE
        cut = piece.rfind(b" ") + 1 if at < end else len(piece)
        found.update(piece[:cut].split())
        carry = piece[cut:]
    return found


def _slice_counts(texts: pa.StringArray, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some texts whose terms are parted by spaces."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten().dictionary_encode()
    codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    if not real.all():
        keep = real[codes]
        codes, doc = codes[keep], doc[keep]
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    n_sources, width = max(1, len(source.dictionary)), max(1, len(names))
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    own, times = np.unique(doc * width + codes, return_counts=True)
    key, place = np.unique(group[own // width] * width + own % width, return_inverse=True)
    n = np.bincount(place, weights=times, minlength=len(key)).astype(np.int64)
    docs = np.bincount(place, minlength=len(key)).astype(np.int64)
    at, term = np.divmod(key, width)
    return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at // n_sources)), source.dictionary.take(pa.array(at % n_sources)), names.take(pa.array(term)), pa.array(n), pa.array(docs)], schema=_COUNTED)


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    langs, sources, raw = batch.column(0), batch.column(1), batch.column(2)
    if not len(raw):
        return
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(raw):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE, side="right")) - 1)
        first, last = int(bounds[row]), int(bounds[stop])
        if last - first > SLICE:  # a single text
            found = _long_text(view[first:last])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py()] * len(found), pa.string()) for x in (langs[row], sources[row])]
                + [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64()), pa.array([1] * len(found), pa.int64())],
                schema=_COUNTED,
            )
        else:
            plain = bytes(view[first:last]).translate(_TERMS)
            texts = pa.StringArray.from_buffers(stop - row, pa.py_buffer((bounds[row : stop + 1] - first).astype(np.int32)), pa.py_buffer(plain))
            yield _slice_counts(texts, langs.slice(row, stop - row), sources.slice(row, stop - row))
        row = stop


def _group(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")]


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a group and in how many of its rows.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z
    lower-cased. Null text, lang and source count as ''. Tasks add up what
    they have read before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _count_batch(b)

    rows = docs.select(*_group(lang_col, source_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in whole parts of UNIT, by decimals wide enough for any long."""
    parts = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", parts, (total + SMOOTH * terms).cast("decimal(20,0)"))


def kept_counts(docs: DataFrame, min_docs: int = 30, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, totals), both written.

    rows: (lang, source, term, n, n_lang) of the terms in at least ``min_docs``
    documents of their language. totals: (lang, source, total, total_lang,
    terms) of every group, also of those without a term.
    """
    counts = materialise(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).select("lang", "term", "n_lang")
    rows = materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept-counts")
    terms = rows.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    groups = docs.select(*_group(lang_col, source_col)).distinct()
    totals = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").join(terms, "lang", "left").na.fill(0)
    return rows, materialise(totals, "group-totals")


def term_report(rows: DataFrame, totals: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source uses more than its language, by how much, the first ``top``.

    A cell is a pair of counts (in the group, in the language) with its number
    of terms. A cell's value ranks behind the terms of all cells of larger
    values; cells whose values begin within ``top`` are expanded.
    """
    group = ["lang", "source"]
    cells = rows.groupBy(*group, "n", "n_lang").agg(F.count("*").alias("terms_of")).join(totals, group)
    cells = cells.withColumn("value", share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("n_lang"), F.col("total_lang"), F.col("terms")))
    cells = materialise(cells.where("value > 0").select(*group, "n", "n_lang", "value", "terms_of"), "count-cells")
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    # Each value has a term at least, so no more than ``top`` values of a group can be in its report.
    values = cells.groupBy(*group, "value").agg(F.sum("terms_of").alias("terms_of")).withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("terms_of").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = values.withColumn("before", before).where(F.col("before") < top).select(*group, "value")
    expanded = rows.join(cells.join(chosen, [*group, "value"]).select(*group, "n", "n_lang", "value"), [*group, "n", "n_lang"])
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*group, F.col("term").alias("item"), "value", "rank")


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial distances of the pairs of sources of a tile over the terms seen there, and how many those are.

    Rows without a term carry the share that a source gives a term it does not use.
    """
    pdf = pdf.sort_values("source", kind="stable")
    bare = pdf["term"].isna().to_numpy()
    idle = pdf[bare].drop_duplicates("source")
    names, code = idle["source"].to_numpy(), {s: k for k, s in enumerate(idle["source"])}
    used = pdf[~bare]
    terms, _ = pd.factorize(used["term"])
    width = int(terms.max()) + 1 if len(terms) else 0
    table = np.repeat(idle["p"].to_numpy(np.int64)[:, None], width, axis=1)
    table[used["source"].map(code).to_numpy(np.int64), terms] = used["p"].to_numpy(np.int64)
    one, other = pdf["one"].iloc[0], pdf["other"].iloc[0]
    of = idle["of"].to_numpy()
    left, right = np.flatnonzero(of == one), np.flatnonzero(of == other)
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for i in left:
        later = right[right > i] if one == other else right
        out["a"] += [names[i]] * len(later)
        out["b"] += list(names[later])
        out["value"] += np.abs(table[later] - table[i]).sum(axis=1).tolist()
    text = {"lang": [pdf["lang"].iloc[0]] * len(out["value"]), "a": out["a"], "b": out["b"]}
    return pd.DataFrame({**{c: pd.Series(v, dtype=object) for c, v in text.items()}, "value": pd.Series(out["value"], dtype=np.int64), "seen": width})


def pair_report(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by its distance, the farthest first.

    Shares of a language form a table of sources by terms. It is cut into
    tiles of some sources by some terms; a task compares the sources of two
    stripes over the terms of one. Terms that neither stripe uses add the same
    to a pair each, so only their number is needed.
    """
    group = ["lang", "source"]
    sized = totals.join(totals.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("stripes")), "lang")
    sized = sized.withColumn("of", F.pmod(F.xxhash64("source"), F.col("stripes")).cast("int")).withColumn("parts", F.greatest(F.ceil(F.col("terms") / TILE_TERMS), F.lit(1)).cast("int"))
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0).cast("long"))
    sized = materialise(sized.select(*group, "stripes", "of", "parts", "total", "terms", p0.alias("p0")), "group-stripes")
    used = rows.join(sized, group).select(*group, "of", "stripes", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    bare = sized.select(*group, "of", "stripes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    each = used.unionByName(bare).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    each = each.select(*group, "of", "part", "term", "p", F.least("of", "with").alias("one"), F.greatest("of", "with").alias("other"))
    partial = each.groupBy("lang", "one", "other", "part").applyInPandas(_tile, "lang string, a string, b string, value long, seen long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    idle = lambda c: sized.select("lang", F.col("source").alias(c), F.col("p0").alias(f"p0_{c}"), *(["terms"] if c == "a" else []))
    pairs = pairs.join(idle("a"), ["lang", "a"]).join(idle("b"), ["lang", "b"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("p0_a") - F.col("p0_b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ways = pairs.select("lang", both.alias("way"), "value").select("lang", "way.*", "value")
    return ways.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))).select(*group, "item", "value", "rank")


def divergence_audit(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) with the parts ``pair`` and ``term``.

    Null or empty text has no terms, but its row still counts as one of its
    group; null lang or source is ''. Repeated rows are rows of their own.
    A text of any length is counted whole. Ties rank by the item's UTF-8
    bytes. A language without kept terms has pairs of value 0 and no terms;
    an empty table gives no rows. Other columns are not read, whatever their
    names. The table of pairs grows with the square of a language's sources.
    """
    rows, totals = kept_counts(docs, min_docs, lang_col, source_col, text_col)
    out = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    pair = pair_report(rows, totals).withColumn("part", F.lit("pair")).select(*out)
    return pair.unionByName(term_report(rows, totals, top).withColumn("part", F.lit("term")).select(*out))
