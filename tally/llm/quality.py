"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each text gets a vector of transformed statistics. Per language and source the
minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps from several starts until the determinant settles, and
texts beyond a Mahalanobis distance are rejected. Vectors are fixed-point
integers and sums are exact, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import ASCII_SPACE_CLASS, ascii_words, id_key, keep_rows, materialise, trim_ascii

#: Statistics of the vector and the smallest spread each is given: a statistic
#: that is the same in nearly all clean texts must not reject at a trifle.
STATISTICS = {"word_length": 0.06, "symbols": 0.12, "dup_lines": 0.12, "repeats": 0.10, "capitals": 0.03}
#: Fixed-point unit of the vectors.
UNIT = 4096
D = len(STATISTICS)


def base_statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the vector x."""
    zero = F.lit(0).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[c.alias(n) for c, n in zip(keep, names)], text.alias("body"))
    df = df.select(*names, "body", ascii_words(F.col("body")).alias("words"))
    df = df.select(
        *names,
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        (F.char_length("body") - F.regexp_count("body", F.lit(f"[{ASCII_SPACE_CLASS}]"))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.transform(F.filter(F.split("body", "\n", -1), lambda x: F.octet_length(trim_ascii(x)) > 0), lambda x: F.xxhash64(x)).alias("lines"),
    )
    rest = [*names, "n", "word_chars", "n_symbols", "n_capitals"]
    df = df.select(
        *rest,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).alias("windows"),
    )
    rest += ["n_lines", "n_dup_lines"]
    # Only texts with a repeated window are sorted.
    df = df.select(*rest, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("sorted"))
    twice = F.transform("sorted", lambda x, i: F.when((x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]), x["p"]))
    df = df.select(*rest, F.sort_array(F.filter(twice, lambda p: p.isNotNull())).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), zero.alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    df = df.select(*rest, F.coalesce(covered, zero).alias("n_repeat_words"))
    n = F.col("n").cast("long")
    words = F.greatest(n, F.lit(1)).cast("double")
    vector = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(10 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        F.col("n_repeat_words") / words,
        F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    ]
    return df.select(
        *names, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.array(*[F.round(v * UNIT).cast("long") for v in vector]).alias("x"),
    ).withColumnsRenamed({a: b for a, b in zip(names, _names(docs, keep))})


def _names(docs: DataFrame, keep: list[Column]) -> list[str]:
    return docs.select(*keep).columns


def chi_square_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


def _quantile_bins(counts: DataFrame, by: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """Per group the smallest bins up to which the given shares of the rows lie; ``counts`` has (by, value, n)."""
    bins = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(value, "n"))).alias("bins"), F.sum("n").alias("total"))
    out = []
    for name, share in parts.items():
        found = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when(a["at"].isNotNull(), a["at"]).when(a["seen"] + b["n"] >= F.ceil(F.col("total") * F.lit(share)), b[value]).alias("at")),
            lambda a: a["at"],
        )
        out.append(found.alias(name))
    return bins.select(*by, "total", *out)


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows with (x, centre, factor) get d2; in steps, so that no part is evaluated twice."""
    at = 0
    for i in range(D):
        rest = F.get("x", F.lit(i)) / UNIT - F.get("centre", F.lit(i))
        for k in range(i):
            rest = rest - F.get("factor", F.lit(at + k)) * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.get("factor", F.lit(at + i)))
        at += i + 1
    z = [F.col(f"z{i}") for i in range(D)]
    return rows.withColumn("d2", sum((v * v for v in z[1:]), z[0] * z[0])).drop(*[f"z{i}" for i in range(D)])


def _bin(d2: Column) -> Column:
    """Distances in bins of about one part in ninety."""
    return F.floor(F.log2(1 + d2) * 64).cast("long")


def _moments(by: list[str], sums: DataFrame, scale: float) -> DataFrame:
    """(by, centre, factor, logdet) from exact sums (n, s0.., p0_0..): mean, and the Cholesky factor of the scaled
    covariance with the squared smallest spreads on top of its diagonal."""
    floor = [v**2 for v in STATISTICS.values()]
    m = sums.select(*by, "n", *[c for c in sums.columns if c[0] == "p"], *[(F.col(f"s{i}").cast("double") / F.col("n") / UNIT).alias(f"m{i}") for i in range(D)])
    cov = [((F.col(f"p{i}_{j}").cast("double") / F.col("n") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (floor[i] if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(D) for j in range(i + 1)]
    return _factored(by, m.select(*by, *[f"m{i}" for i in range(D)], *cov))


def _factored(by: list[str], m: DataFrame) -> DataFrame:
    """(by, centre, factor, logdet) from columns m0.. (centre) and c0_0.. (scatter, lower half)."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            m = m.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = sum((2 * F.log(f"l{i}_{i}") for i in range(1, D)), 2 * F.log("l0_0"))
    return m.select(*by, F.array(*[f"m{i}" for i in range(D)]).alias("centre"), F.array(*[f"l{i}_{j}" for i in range(D) for j in range(i + 1)]).alias("factor"), F.round(logdet, 9).alias("logdet"))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, centre, factor, logdet): three estimates of each group to begin with.

    0: medians and the quartiles' distances, uncorrelated. 1: medians with the
    scatter of the directions in which the rows lie from them (spatial signs).
    2: mean and covariance of all rows.
    """
    cells = rows.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k", "v").agg(F.count("*").alias("n"))
    quartiles = _quantile_bins(cells, ["g", "k"], "v", {"low": 0.25, "mid": 0.5, "high": 0.75})
    floors = F.array(*[F.lit(f) for f in STATISTICS.values()])
    spread = F.greatest((F.col("high") - F.col("low")) / (1.349 * UNIT), F.get(floors, F.col("k")))
    wide = quartiles.groupBy("g").agg(*[F.max(F.when(F.col("k") == i, F.col("mid") / UNIT)).alias(f"m{i}") for i in range(D)], *[F.max(F.when(F.col("k") == i, spread)).alias(f"e{i}") for i in range(D)])
    wide = materialise(wide, "quality-quartiles")
    by = ["g", "start"]
    mids = [f"m{i}" for i in range(D)]
    lower = [(i, j) for i in range(D) for j in range(i + 1)]
    plain = _factored(by, wide.select("g", F.lit(0).alias("start"), *mids, *[(F.col(f"e{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in lower]))

    x = [F.get("x", F.lit(i)) for i in range(D)]
    z = rows.join(wide, "g").select("g", "x", *[((x[i] / UNIT - F.col(f"m{i}")) / F.col(f"e{i}")).alias(f"z{i}") for i in range(D)])
    z = z.withColumn("norm", F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(1, D)), F.col("z0") ** 2), F.lit(1e-9)))
    sign = [F.sum(F.round(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") * 1_000_000).cast("long")).alias(f"q{i}_{j}") for i, j in lower]
    sums = materialise(z.groupBy("g").agg(F.count("*").alias("n"), *sign, *_sums(x)), "quality-starts")
    j = sums.join(wide, "g")
    scatter = [(D * F.col(f"q{a}_{b}") / 1e6 / F.col("n") * F.col(f"e{a}") * F.col(f"e{b}") + (F.col(f"e{a}") ** 2 * 1e-3 if a == b else F.lit(0.0))).alias(f"c{a}_{b}") for a, b in lower]
    signs = _factored(by, j.select("g", F.lit(1).alias("start"), *mids, *scatter))
    whole = _moments(by, sums.select("g", F.lit(2).alias("start"), "n", *[c for c in sums.columns if c[0] in "sp"]), 1.0)
    return materialise(plain.unionByName(signs).unionByName(whole), "quality-model")


def _sums(x: list[Column]) -> list[Column]:
    return [F.sum(x[i]).alias(f"s{i}") for i in range(D)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i + 1)]


def _concentrate(rows: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """A concentration step: the estimate from the ``share`` of each group's rows that the given one puts nearest.

    One pass over the rows gives counts and exact sums by distance, in bins of
    about one part in ninety; the rows of the bin with the last of the share
    all belong to it.
    """
    by = ["g", "start"]
    # Consistency at the normal distribution of a scatter from the inner share.
    scale = share / chi_square_cdf(chi_square_quantile(share, D), D + 2)
    d = _with_distance(rows.join(model, "g")).select(*by, _bin(F.col("d2")).alias("bin"), "x")
    bins = materialise(d.groupBy(*by, "bin").agg(F.count("*").alias("n"), *_sums([F.get("x", F.lit(i)) for i in range(D)])), "quality-bins")
    inner = bins.join(_quantile_bins(bins, by, "bin", {"cut": share}).select(*by, "cut"), by).where("bin <= cut")
    # Sums of a bin fit 64 bits for up to 10^10 rows; those of all its bins are decimals.
    sums = inner.groupBy(*by).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in bins.columns if c not in (*by, "bin")])
    return materialise(_moments(by, sums, scale), "quality-model")


def fit(vectors: DataFrame, share: float = 0.75, min_group: int = 5 * D, settled: float = 1e-3) -> DataFrame:
    """(g_lang, g_source, centre, factor) per language and source from (lang, source, x) rows.

    Minimum covariance determinant: concentration steps from three starts; the
    start with the smallest determinant after two steps goes on until the
    logarithm of no group's determinant falls by more than ``settled``, and
    the estimate of the smallest determinant counts. ``share`` of a group's
    rows support it. The diagonal has the squares of the smallest spreads in
    STATISTICS added, so that a statistic that hardly varies has no
    determinant of 0. Languages and sources with under ``min_group`` rows,
    five for each dimension, are pooled by language, and languages with too
    few of those together; null languages and sources are groups of their own.
    The result has a row for each pair of (lang, source).
    """
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    by_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    level = F.when(~small, F.lit(0)).when(by_lang >= min_group, F.lit(1)).otherwise(F.lit(2))
    groups = sizes.withColumn("level", level).select(
        "lang", "source",
        F.xxhash64("level", F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))).alias("g"),
    )
    groups = materialise(groups, "quality-groups")
    joined = vectors.join(groups, vectors["lang"].eqNullSafe(groups["lang"]) & vectors["source"].eqNullSafe(groups["source"]))
    rows = materialise(joined.select("g", "x"), "quality-vectors")

    model = _concentrate(rows, _concentrate(rows, _starts(rows), share), share)
    best = F.struct("logdet", "start", "centre", "factor")
    model = materialise(model.groupBy("g").agg(F.min(best).alias("b")).select("g", "b.*"), "quality-model")
    while True:
        new = _concentrate(rows, model, share).select("g", F.struct("logdet", "start", "centre", "factor").alias("new"))
        j = materialise(model.select("g", best.alias("old")).join(new, "g"), "quality-settling")
        model = materialise(j.select("g", F.least("old", "new").alias("b")).select("g", "b.*"), "quality-model")
        if j.where(F.col("new.logdet") < F.col("old.logdet") - settled).isEmpty():
            return groups.join(model, "g").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "centre", "factor")


def judge(stats: DataFrame, model: DataFrame, level: float = 0.99999) -> DataFrame:
    """``stats`` (with lang, source, x, base_failed) gets distance and kept.

    Rejected are base failures and vectors beyond the chi-square quantile
    ``level``. A pair of language and source that the model lacks rejects by
    the base rules only.
    """
    cut = chi_square_quantile(level, D)
    j = stats.join(model, stats["lang"].eqNullSafe(model["g_lang"]) & stats["source"].eqNullSafe(model["g_source"]), "left")
    d = _with_distance(j).drop("centre", "factor", "g_lang", "g_source")
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).withColumnRenamed("d2", "distance2")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, base statistics, base_failed, distance2 and kept.

    Null or empty text has no words and fails the base rules; null languages
    and sources form groups of their own; repeated rows are judged alike, and
    so are all rows at the distance of the cut, which are kept. A very long
    text is one vector like any other; an empty table gives no rows. The
    estimate rests on the texts that pass the base rules. Other columns are
    not read.
    """
    keep = [F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    stats = materialise(base_statistics(docs, keep, text_col), "quality-stats")
    model = fit(stats.where(~F.col("base_failed")).select("lang", "source", "x"))
    return judge(stats, model).drop("lang", "source", "x").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    Null and empty texts fail the base rules and go. Null languages and
    sources are groups of their own, null ids are ids like others, repeated
    rows fare alike and are all kept or all dropped. Texts of any length are
    judged whole; an empty table gives no rows.
    """
    keep = [id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    stats = materialise(base_statistics(docs, keep, text_col), "quality-stats")
    model = fit(stats.where(~F.col("base_failed")).select("lang", "source", "x"))
    kept = judge(stats, model).where("kept").select("id", "row_key", F.lit(False).alias("single")).distinct()
    return keep_rows(docs, kept, id_col, text_col)
