"""Mixing to target weights with soft domain membership, DataFrame functions only.

A classifier fitted on the labelled table gives each document a posterior over
domains. Its first layer weighs every hashed word and word ending by how far
the labelled rows of a domain hold it more often than those of the first one;
its second layer is a logistic regression, fitted by Newton steps, on the sums
of these weights and a few statistics. Projected-gradient least squares then
finds nonnegative document rates whose expected token totals per domain match
the targets: rates start at 1, each step moves them against the gradient and
sets negative ones to 0. Only the domains' totals (a few numbers) reach the
driver in each step; rates follow from them and the posteriors, row by row.
"""

from __future__ import annotations

import warnings
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import ascii_words, id_key, materialise

#: Domains told apart by the labelled table.
DOMAINS = ["clean", "low", "toxic"]
#: Shares of the expected tokens that the mix should have.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
#: Hash values of words, and of word endings behind them in the same table.
WORDS, ENDINGS = 1 << 16, 1 << 14
#: Labelled rows that an unseen word counts for, and the standard errors by which a weighed word must differ between domains.
PRIOR_ROWS, CERTAIN = 2.0, 3.75
#: Fixed-point units: of a word's weight, and of the sums of the regression, which are exact and so alike in every run.
WEIGHT_UNIT, SUM_UNIT = 256, 1_000_000
#: Signs at the ends of a word that do not belong to it.
MARKS = ".,;:!?\"'()"
#: Steps whose pulls are replayed row by row before the rates are written out.
REPLAYED = 6


def domain_label(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row: toxic goes before low quality; a null label leaves it unlabelled."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "clean")


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n (words), kinds (distinct words) and hashes (of its words and word endings, each once) of each ``body``."""
    word = lambda w: F.xxhash64(F.trim(F.lower(w), F.lit(MARKS))).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    ending = lambda w: (F.xxhash64(F.lit("ending"), F.substring(w, -2, 2)).bitwiseAND(F.lit(ENDINGS - 1)) + WORDS).cast("int")
    df = rows.select(*keep, ascii_words(F.col("body")).alias("words"))
    df = df.select(*keep, F.size("words").alias("n"), F.array_distinct(F.transform("words", word)).alias("own"), F.array_distinct(F.transform("words", ending)).alias("ends"))
    return df.select(*keep, "n", F.size("own").alias("kinds"), F.concat("own", "ends").alias("hashes"))


def _vector(hashed: DataFrame, keep: list[str], weights: list[int]) -> DataFrame:
    """``keep`` with n and x, the inputs of the regression.

    The weights of the second and third domain share a number: 32 bits each.
    """
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to a constant
    df = hashed.select(*keep, "n", "kinds", F.aggregate("hashes", F.lit(0).cast("long"), lambda a, h: a + F.get(table, h)).alias("sum"))
    low = F.pmod(F.col("sum") + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    df = df.select(*keep, "n", "kinds", "sum", low.alias("low"))
    df = df.select(*keep, "n", "kinds", (F.col("low") / WEIGHT_UNIT).alias("w1"), (F.shiftright(F.col("sum") - F.col("low"), 32) / WEIGHT_UNIT).alias("w2"))
    damped = lambda w: F.signum(w) * F.log1p(F.abs(w))
    words = F.greatest(F.col("n"), F.lit(1))
    parts = [F.lit(1.0), damped(F.col("w2")), damped(F.col("w1")), F.col("kinds") / words, F.log1p(words) / 4, F.sqrt(F.greatest(-F.col("w1"), F.lit(0.0))) / 4]
    return df.select(*keep, "n", F.array(*[F.round(x, 6) for x in parts]).alias("x"))


#: Number of inputs of the regression, as _vector makes them.
INPUTS = 6


def _with_posterior(rows: DataFrame, beta: list[list[float]]) -> DataFrame:
    """``rows`` with p0, p1, ...: the softmax over the first domain's score 0 and those of ``beta``.

    The coefficients are constant arrays, so all of Newton's steps share their compiled code.
    """
    keep = rows.columns
    score = lambda bs: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in bs]), lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    df = rows.select(*keep, F.lit(0.0).alias("s0"), *[score(bs).alias(f"s{k + 1}") for k, bs in enumerate(beta)])
    names = [f"s{k}" for k in range(len(DOMAINS))]
    df = df.select(*keep, *names, F.greatest(*names).alias("top"))
    df = df.select(*keep, *[F.exp(F.greatest(F.col(s) - F.col("top"), F.lit(-40.0))).alias(s) for s in names])
    df = df.select(*keep, *names, sum((F.col(s) for s in names[1:]), F.col("s0")).alias("whole"))
    return df.select(*keep, *[F.round(F.col(s) / F.col("whole"), 9).alias(f"p{k}") for k, s in enumerate(names)])


def _word_weights(rows: DataFrame, n: list[int]) -> list[int]:
    """The packed weights of all hash values, from labelled rows (domain, hashes) of which ``n`` fall in each domain."""
    counted = rows.select("domain", F.explode("hashes").alias("h")).groupBy("h").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    weights, first = [0] * (WORDS + ENDINGS), DOMAINS[0]
    # At most a row for each hash value.
    for r in counted.collect():
        packed = 0
        for k, d in enumerate(DOMAINS[1:], 1):
            seen = r[d] + r[first]
            if seen and n[k] and n[0]:
                q = n[k] / (n[k] + n[0])
                if abs(r[d] - seen * q) >= CERTAIN * sqrt(seen * q * (1 - q)):
                    p = (r[d] + PRIOR_ROWS * q) / (seen + PRIOR_ROWS)
                    packed += round(log(p / (1 - p) * (1 - q) / q) * WEIGHT_UNIT) << (32 * (k - 1))
        weights[r["h"]] = packed
    return weights


def _regression(rows: DataFrame, ridge: float = 1.0, most_steps: int = 30) -> list[list[float]]:
    """Coefficients of the domains behind the first, from rows (domain, x); RuntimeError if Newton's steps do not settle."""
    d, k = INPUTS, len(DOMAINS) - 1
    beta = [[0.0] * d for _ in range(k)]
    total = lambda c: F.coalesce(F.sum(F.round(c * SUM_UNIT).cast("long")), F.lit(0))
    x = [F.get("x", F.lit(i)) for i in range(d)]
    for _ in range(most_steps):
        p = [F.col(f"p{a + 1}") for a in range(k)]
        sums = [total(x[i] * ((F.col("domain") == DOMAINS[a + 1]).cast("double") - p[a])).alias(f"g{a}_{i}") for a in range(k) for i in range(d)]
        sums += [total(p[a] * (float(a == b) - p[b]) * x[i] * x[j]).alias(f"h{a}_{b}_{i}_{j}") for a in range(k) for b in range(a + 1) for i in range(d) for j in range(i + 1)]
        r = _with_posterior(rows, beta).agg(*sums).first()
        g = [r[f"g{a}_{i}"] / SUM_UNIT - ridge * beta[a][i] for a in range(k) for i in range(d)]
        h = [[r[f"h{max(a, b)}_{min(a, b)}_{max(i, j)}_{min(i, j)}"] / SUM_UNIT + ridge * (a == b and i == j) for b in range(k) for j in range(d)] for a in range(k) for i in range(d)]
        step = _solve(h, g)
        beta = [[beta[a][i] + step[a * d + i] for i in range(d)] for a in range(k)]
        if max(map(abs, step)) < 1e-4:
            return [[round(b, 6) for b in bs] for bs in beta]
    raise RuntimeError(f"the regression did not settle in {most_steps} steps")


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> dict:
    """The model {"weights": [...], "beta": [[...], ...]}, of a size that does not depend on the tables.

    Fitted on at most about ``most_rows`` labelled rows, chosen by a hash of
    their ids. Labels of a null id belong to the documents of a null id; of
    several labels of one id the last in the alphabet counts. Without labelled
    rows all weights are 0.
    """
    lab = labels.select(id_key(id_col).alias("id"), domain_label(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null").groupBy("id").agg(F.max("domain").alias("domain"))
    total = lab.count()
    if total > most_rows:
        lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most_rows / total))
    # About most_rows rows of an id and a domain.
    rows = docs.select(id_key(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(F.broadcast(lab), "id")
    rows = materialise(_hashed(rows, ["domain"]), "mix-labelled")
    n = list(rows.agg(*[F.count_if(F.col("domain") == d) for d in DOMAINS]).first())
    weights = _word_weights(rows, n)
    return {"weights": weights, "beta": _regression(materialise(_vector(rows, ["domain"], weights), "mix-vectors"))}


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own_id, id, row_key, n_tokens, p) per row; tokens are words, p the posterior over the domains.

    A null or empty text has no tokens and the posterior of its other inputs.
    """
    own = ["own_id", "id", "row_key"]
    rows = docs.select(F.col(id_col).alias("own_id"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    judged = _with_posterior(_vector(_hashed(rows, own), own, model["weights"]), model["beta"])
    return judged.select(*own, F.col("n").cast("long").alias("n_tokens"), F.array(*[f"p{k}" for k in range(len(DOMAINS))]).alias("p"))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a few unknowns."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (m[i][n] - sum(m[i][k] * out[k] for k in range(i + 1, n))) / m[i][i]
    return out


def _moved(steps: list[tuple[list[float], float]]) -> Column:
    """The columns rate and ahead (the point the next gradient is taken at) after these steps of a pull and a momentum each.

    A step moves ``ahead`` by the posterior-weighted pull, projects it to
    between 0 and ``top``, or to 1 in a ``held`` row, which is the new rate,
    and looks on in the direction of the change.
    """
    state = F.struct(F.col("rate").alias("rate"), F.col("ahead").alias("ahead"))
    if not steps:
        return state
    dot = lambda g: sum((F.get("p", F.lit(k)) * F.get(g, F.lit(k)) for k in range(1, len(DOMAINS))), F.get("p", F.lit(0)) * F.get(g, F.lit(0)))

    def step(s: Column, g: Column) -> Column:
        return F.transform(F.array(F.when(F.col("held"), 1.0).otherwise(F.least(F.col("top"), F.greatest(F.lit(0.0), s["ahead"] - dot(g))))), lambda r: F.struct(r.alias("rate"), (r + F.get(g, F.lit(len(DOMAINS))) * (r - s["rate"])).alias("ahead")))[0]

    history = F.array(*[F.array(*[F.lit(float(x)) for x in (*pull, momentum)]) for pull, momentum in steps])
    return F.aggregate(history, state, step)


def solve_rates(soft: DataFrame, targets: dict[str, float] | None = None, most_steps: int = 200, tolerance: float = 1e-4, whole: str | None = None) -> tuple[DataFrame, dict]:
    """``soft`` with ``rate``, and a report of the totals reached.

    Minimises the distance of the expected domain totals sum(tokens * rate * p)
    from the targets, which share out all tokens. The distance is measured in
    the metric of M = sum(tokens * p p') over the rows that may change, in which
    a step of 1 is the projected gradient's safe step; steps have momentum.
    They end when all totals are within ``tolerance``
    of all tokens, or when the distance no longer falls: then no rates meet the
    targets (as where a domain has no documents), those nearest to them come
    back, the report says met = False and a warning is given; so it does where
    neither comes about in ``most_steps`` (settled = False). With ``whole`` the
    mix only cuts: the targets are set in proportion to what that domain has,
    documents as likely in it as in any other keep the rate 1, and all other
    rates are at most 1.
    """
    k = len(DOMAINS)
    targets = targets or TARGETS
    t = F.col("n_tokens").cast("double")
    p = [F.get("p", F.lit(i)) for i in range(k)]
    held, top = F.lit(False), float("inf")
    if whole is not None:
        at = DOMAINS.index(whole)
        held, top = p[at] >= F.array_max("p"), 1.0
    row = soft.agg(F.sum("n_tokens").alias("total"), *[F.sum(t * p[i]).alias(f"t{i}") for i in range(k)], *[F.sum(F.when(~held, t * p[i] * p[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    total = float(row["total"] or 0)
    m = [[float(row[f"m{max(i, j)}_{min(i, j)}"] or 0) for j in range(k)] for i in range(k)]
    ridge = 1e-9 * max(1.0, total)
    m = [[x + ridge * (i == j) for j, x in enumerate(r)] for i, r in enumerate(m)]
    weight = sum(targets[d] for d in DOMAINS)
    goal = [total * targets[d] / weight for d in DOMAINS]
    if whole is not None:
        has = float(row[f"t{at}"] or 0)
        goal = [g * has / goal[at] for g in goal] if has and goal[at] else goal
    soft = soft.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0), "held": held, "top": F.lit(top)})
    own = [c for c in soft.columns if c not in ("rate", "ahead", "held", "top")]
    pending: list[tuple[list[float], float]] = []
    far, pace, settled = None, 1.0, True
    for steps in range(most_steps + 1):
        if len(pending) == REPLAYED:
            soft, pending = materialise(soft.select(*own, "held", "top", _moved(pending).alias("s")).select(*own, "held", "top", "s.*"), "mix-rates"), []
        now = soft.select(t.alias("t"), "p", _moved(pending).alias("s"))
        sums = now.agg(*[F.sum(F.col("t") * F.col(f"s.{c}") * p[i]).alias(f"{c}{i}") for c in ("rate", "ahead") for i in range(k)]).first()
        reached = [float(sums[f"rate{i}"] or 0) for i in range(k)]
        rest = [a - b for a, b in zip(reached, goal)]
        met = total == 0 or max(map(abs, rest)) <= tolerance * total
        before, far = far, sum(x * y for x, y in zip(rest, _solve(m, rest)))
        if met or before is not None and before >= far >= before * (1 - 1e-3):
            break
        if steps == most_steps:
            settled = False
            break
        # The momentum grows from step to step and starts again when a step led away.
        last, pace = (pace, (1 + sqrt(1 + 4 * pace * pace)) / 2) if before is None or far < before else (1.0, 1.0)
        pending.append((_solve(m, [float(sums[f"ahead{i}"] or 0) - b for i, b in enumerate(goal)]), (last - 1) / pace))
    report = {"steps": steps, "met": met, "settled": settled, "total": total, "goal": dict(zip(DOMAINS, goal)), "reached": dict(zip(DOMAINS, reached))}
    if not met:
        warnings.warn(f"no rates meet the targets: {report}", stacklevel=2)
    return soft.select(*own, F.round(_moved(pending)["rate"], 6).alias("rate")), report


def _rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, targets: dict[str, float] | None, whole: str | None) -> DataFrame:
    soft = materialise(posteriors(docs, fit_classifier(docs, labels, id_col, text_col), id_col, text_col), "mix-posteriors")
    return solve_rates(soft, targets, whole=whole)[0]


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """(own id, row_key, n_tokens, posteriors, rate) per row of ``docs``.

    Null or empty text has no tokens: its rate is as its posterior says and
    changes no total. Rows of a null or repeated id are rows of their own. A
    very long text is one row with all its words. Without labelled rows the
    posterior is the same for all; an empty table gives no rows. Columns
    besides the named ones are not read.
    """
    return _rated(docs, labels, id_col, text_col, targets, None)


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, whole: str | None = "clean") -> DataFrame:
    """``docs`` with each row as often as its rate says, all columns unchanged.

    The fractional part of a rate is settled by a hash of id and text, so the
    outcome is the same in every run; repeated rows fare alike.
    """
    rated = _rated(docs, labels, id_col, text_col, targets, whole)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "id", "row_key"), F.lit(1_000_003)) / 1_000_003
    times = rated.select("id", "row_key", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("times")).groupBy("id", "row_key").agg(F.max("times").alias("times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"))
    out = rows.join(times, ["id", "row_key"]).where("times > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
