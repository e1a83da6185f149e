"""A quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; every text of the training folds is
unlabelled web text. A first discriminator of the two gives scores from which
the share of good text among the unlabelled, the class prior, is estimated.
Then a linear model with logistic loss minimises the unbiased risk made of
the prior, the positives and the unlabelled, whose share for the bad class
must stay nonnegative: steps that would make it negative are shortened.
Texts become a few statistics once; each pass over them adds up a fixed number
of sums, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import id_key, materialise

#: Classes of bytes: bytes of one class count as one sign.
KINDS = ("lower", "upper", "digit", "space", "line", "stop", "comma", "exclaim", "symbol", "bar", "other", "high")
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, EXCLAIM, SYMBOL, BAR, OTHER, HIGH = range(len(KINDS))
N = len(KINDS)
#: Bytes of a text whose pairs are counted at once.
PIECE = 1 << 20
#: Folds by the checksum of the id; fold 0 is held out.
FOLDS = 5
#: Standardised statistics are cut off here, so that no rare sign decides alone.
CUT = 3.0
RIDGE = 0.01
#: Step lengths tried in one pass.
LENGTHS = [0.5**i for i in range(8)]
#: Bins of the discriminator's scores, between -SPAN and SPAN.
BINS, SPAN = 2000, 8.0


def _kinds() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for low, high, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        table[ord(low) : ord(high) + 1] = kind
    for signs, kind in ((b" \t\r\x0b\x0c", SPACE), (b"\n", LINE), (b".", STOP), (b",", COMMA), (b"!?", EXCLAIM), (b"#*$%&<>", SYMBOL), (b"|", BAR)):
        table[list(signs)] = kind
    table[128:] = HIGH
    return table


_KIND = _kinds()


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces of about PIECE bytes that end behind white space."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(s, at, at + PIECE) for s in (b" ", b"\n")) + 1
        if cut <= at:  # a word that is longer than a piece
            cut = min((k + 1 for k in (raw.find(s, at + PIECE) for s in (b" ", b"\n")) if k >= 0), default=len(raw))
        if cut == len(raw):
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:] if at else raw


def statistics(raw: bytes) -> list[float]:
    """The inputs of the model: a 1, then shares of signs, of pairs of signs, of repeated words and lines, and lengths.

    Digits and rare signs are no inputs: personal data and licences say nothing about quality. An empty text has zeros behind the 1.
    """
    if not raw:
        return [1.0] + [0.0] * (INPUTS - 1)
    pairs = np.zeros(N * N, np.int64)
    n_words, same, last, seen = 0, 0, b"", set()
    before = -1
    for piece in _pieces(raw):
        kinds = _KIND[np.frombuffer(piece, np.uint8)].astype(np.int64)
        pairs += np.bincount(kinds[:-1] * N + kinds[1:], minlength=N * N)
        if before >= 0:
            pairs[before * N + kinds[0]] += 1
        before = kinds[-1]
        words = piece.split()
        if words:
            same += (words[0] == last) + sum(a == b for a, b in zip(words, words[1:]))
            n_words, last = n_words + len(words), words[-1]
            seen.update(words)
    table = pairs.reshape(N, N)
    signs = table.sum(axis=1)
    signs[before] += 1
    lines = raw.split(b"\n")
    words, n_lines = max(1, n_words), len(lines)
    share = [sqrt(signs[k] / len(raw)) for k in (LOWER, UPPER, SPACE, LINE, STOP, COMMA, EXCLAIM, SYMBOL, BAR, HIGH)]
    per_word = lambda count: sqrt(count / words)
    return [
        1.0, *share, len(seen) / words, per_word(same), log(1 + n_words) / 4, log(1 + words / n_lines) / 4, sqrt(1 - len(set(lines)) / n_lines),
        per_word(table[UPPER, UPPER]), per_word(table[[LOWER, UPPER, STOP, COMMA], EXCLAIM].sum()), per_word(table[[LOWER, HIGH, STOP, COMMA], SYMBOL].sum()),
        per_word(table[SPACE, BAR]), per_word(table[SYMBOL, SYMBOL]), per_word(table[EXCLAIM, EXCLAIM]), per_word(table[SPACE, UPPER]),
        (signs[LOWER] + signs[UPPER] + signs[HIGH]) / words / 10, per_word(table[STOP, [SPACE, LINE]].sum()), per_word(table[COMMA, SPACE]),
    ]


INPUTS = 26


def held_out(id_col: str) -> Column:
    """True for the rows of fold 0: the checksum of the id as text, a null id being ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def text_vectors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (own_id, held_out, trusted, x), a row for each text.

    ``trusted`` are training rows all of whose labels say good. Labels of
    held-out ids are dropped before they meet a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(2)], np.float32).reshape(-1, INPUTS)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * INPUTS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vectors], names=["own_id", "held_out", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    vectors = rows.mapInArrow(run, "own_id long, held_out boolean, x array<float>").withColumn("id", id_key("own_id"))
    good = labels.where(~held_out(id_col) & F.col("quality").isNotNull()).groupBy(id_key(id_col).alias("id")).agg((F.min("quality") == 1).alias("trusted"))
    return materialise(vectors.join(good.where("trusted"), "id", "left").select("own_id", "held_out", F.coalesce("trusted", F.lit(False)).alias("trusted"), "x"), "text-vectors")


def _sums(vectors: DataFrame, count: int, of: Callable[[np.ndarray], np.ndarray], sets: tuple[bool, ...] = (False, True)) -> np.ndarray:
    """Per set (unlabelled, trusted) the sums of ``of`` over its vectors: each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sets), count))
        for b in batches:
            x, good = b.column(1).flatten().to_numpy().reshape(-1, INPUTS).astype(np.float64), b.column(0).to_numpy(zero_copy_only=False)
            for k, only in enumerate(sets):
                chosen = x[good] if only else x
                if len(chosen):
                    total[k] += of(chosen)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    rows = vectors.where("not held_out").select("trusted", "x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(len(sets) * count)
    # As many numbers as there are sums.
    for r in rows.collect():
        out[r["k"]] = r["v"]
    return out.reshape(len(sets), count)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _ready(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - scale[0]) / scale[1], -CUT, CUT)
    z[:, 0] = 1.0
    return z


def _slopes(vectors: DataFrame, scale: np.ndarray, w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """Per set: its size, the sum of its vectors, their sum weighed by the score, and the curvature of the loss."""

    def of(x: np.ndarray) -> np.ndarray:
        z = _ready(x, scale)
        s = _sigmoid(z @ w)
        return np.concatenate([[len(z)], z.sum(axis=0), s @ z, ((z.T * (s * (1 - s))) @ z).ravel()])

    d = INPUTS
    return [(t[0], t[1 : d + 1], t[d + 1 : 2 * d + 1], t[2 * d + 1 :].reshape(d, d)) for t in _sums(vectors, 1 + 2 * d + d * d, of)]


def _losses(vectors: DataFrame, scale: np.ndarray, w: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Per set and step length the sums of the losses as a good and as a bad text."""

    def of(x: np.ndarray) -> np.ndarray:
        z = _ready(x, scale)
        g = (z @ w)[:, None] - (z @ step)[:, None] * np.array(LENGTHS + [0.0])
        return np.concatenate([np.logaddexp(0, -g).sum(axis=0), np.logaddexp(0, g).sum(axis=0)])

    n = len(LENGTHS) + 1
    return _sums(vectors, 2 * n, of).reshape(2, 2, n)


_PENALTY = np.array([0.0] + [RIDGE] * (INPUTS - 1))


def _discriminator(vectors: DataFrame, scale: np.ndarray, most_steps: int = 12) -> np.ndarray:
    """Weights that tell trusted from unlabelled texts, both sets of equal weight."""
    w = np.zeros(INPUTS)
    for _ in range(most_steps):
        (n_u, _, s_u, h_u), (n_p, x_p, s_p, h_p) = _slopes(vectors, scale, w)
        step = np.linalg.solve((h_u / n_u + h_p / n_p) / 2 + np.diag(_PENALTY + 1e-9), (s_u / n_u - (x_p - s_p) / n_p) / 2 + _PENALTY * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def class_prior(vectors: DataFrame, scale: np.ndarray, w: np.ndarray, confidence: float = 0.1) -> float:
    """The share of good text among the unlabelled: the smallest ratio of both sets' shares above a score.

    Where only good text scores that high, the ratio is the prior; the
    threshold is the one whose upper bound of the ratio is smallest, so that
    few rows above it do not mislead.
    """

    def of(x: np.ndarray) -> np.ndarray:
        g = np.clip(_ready(x, scale) @ w, -SPAN, SPAN)
        return np.bincount(np.minimum(((g + SPAN) / (2 * SPAN) * BINS).astype(np.int64), BINS - 1), minlength=BINS).astype(np.float64)

    counts = _sums(vectors, BINS, of)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] / counts.sum(axis=1, keepdims=True)
    unlabelled, trusted = above[:, above[1] > 0]
    slack = sum(sqrt(log(4 / confidence) / 2 / n) for n in counts.sum(axis=1))
    best = int(np.argmin((unlabelled + 1.01 * slack) / trusted))
    return float(np.clip(unlabelled[best] / trusted[best], 0.001, 0.999))


def fit(vectors: DataFrame, most_steps: int = 25) -> dict:
    """{"scale", "weights", "prior", "risk"} of a table of :func:`text_vectors`; weights are None without trusted texts.

    The risk of weights w is prior * E_good[loss as good] + max(0, bad part),
    bad part = E_unlabelled[loss as bad] - prior * E_good[loss as bad]. Newton
    steps on it are shortened until the risk falls and the bad part is not
    negative; the fit ends where no step does both.
    """
    moments = _sums(vectors, 1 + 2 * INPUTS, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, trusted = moments[0, 0], moments[1, 0]
    if not trusted:
        return {"scale": None, "weights": None, "prior": None, "risk": None}
    mean = moments[0, 1 : INPUTS + 1] / n
    scale = np.stack([mean, np.sqrt(np.maximum(moments[0, INPUTS + 1 :] / n - mean * mean, 0)) + 1e-3])
    prior = class_prior(vectors, scale, _discriminator(vectors, scale))
    w, risk = np.zeros(INPUTS), None
    for _ in range(most_steps):
        (_, _, s_u, h_u), (_, x_p, _, _) = _slopes(vectors, scale, w)
        step = np.linalg.solve(h_u / n + np.diag(_PENALTY + 1e-9), s_u / n - prior * x_p / trusted + _PENALTY * w)
        (_, bad_u), (good_p, bad_p) = _losses(vectors, scale, w, step)
        bad = bad_u / n - prior * bad_p / trusted
        ridge = np.array([(_PENALTY * (w - f * step) ** 2).sum() / 2 for f in LENGTHS + [0.0]])
        risks = prior * good_p / trusted + np.maximum(bad, 0) + ridge
        fine = [k for k in range(len(LENGTHS)) if bad[k] >= 0 and risks[k] < risks[-1]]
        if not fine:
            break
        w, risk = w - LENGTHS[fine[0]] * step, float(risks[fine[0]])
        if np.abs(LENGTHS[fine[0]] * step).max() < 1e-4:
            break
    return {"scale": scale, "weights": w, "prior": prior, "risk": risk}


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own_id, held_out, score, predicted) per row: how likely its label is 1, and whether the score reaches ``threshold``.

    Null text is an empty one; an empty text is scored by the model like any
    other. Texts of any length are read whole. Rows of a repeated id are rows
    of their own and share its labels; a null id is held out. Of several labels
    of one id all must be 1 to be trusted; null labels say nothing. Without
    trusted texts every score is 0.5; an empty table gives no rows. Other
    columns, such as lang and source, are not read, whatever their names.
    """
    vectors = text_vectors(docs, labels, id_col, text_col)
    model = fit(vectors)
    scale, weights = model["scale"], model["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, INPUTS).astype(np.float64)
            score = np.full(len(x), 0.5) if weights is None else np.round(_sigmoid(_ready(x, scale) @ weights), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["own_id", "held_out", "score", "predicted"])

    return vectors.select("own_id", "held_out", "x").mapInArrow(run, "own_id long, held_out boolean, score double, predicted int")
