"""Source divergence, centroid clustering and the positive-unlabelled classifier against plain walks."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import clustering, divergence, pu_quality

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, p string, value string, cluster string, x string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, *("x", 1, "x", "x", "x", "x")) for i, t, la, s in rows], SCHEMA)


def brute_audit(rows, min_docs, top):
    rows = [(t or "", la or "", s or "") for _, t, la, s in rows]
    docs, whole, own = collections.Counter(), collections.Counter(), collections.Counter()
    for t, la, s in rows:
        terms = TERM.findall(t.translate(UPPER))
        docs.update((la, x) for x in set(terms))
        whole.update((la, x) for x in terms)
        own.update((la, s, x) for x in terms)
    out = set()
    for lang in {la for _, la, _ in rows}:
        kept = sorted((x for (la, x), n in docs.items() if la == lang and n >= min_docs), key=str.encode)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}
        sources = sorted({s for _, la, s in rows if la == lang})
        p = {s: share({x: own[lang, s, x] for x in kept}) for s in sources}
        q = share({x: whole[lang, x] for x in kept})
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            far = sorted((q[x] - p[s][x], x.encode()) for x in kept if own[lang, s, x] and p[s][x] > q[x])
            out |= {(lang, s, "term", x.decode(), -v, k) for k, (v, x) in enumerate(far[:top], 1)}
    return out


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(11)
    words = ["tree", "House", "élan", "ÉLAN", "日本", "x1y", "a", "don't", "zz", "straße", "ok_ok"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(220):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "", None, "s3", "ß", "Z"])
        rows.append((k, " ".join(rng.choice(words[: 20 + k % 50]) for _ in range(rng.randint(0, 40))), lang, source))
    rows += rows[:5] + [(None, None, "en", "only-null"), (None, "", "fr", "s1"), (7, " \n123 ", "fr", None), (8, "tree " * 30_000 + "Ende", "de", "s9"), (9, "z" * 50_000, "de", "s9")]
    return rows


@pytest.mark.parametrize("tile", [None, (2, 5)])
def test_divergence(spark, mixed, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(divergence, "TILE_SOURCES", tile[0])
        monkeypatch.setattr(divergence, "TILE_TERMS", tile[1])
    for top in (50, 3):
        got = divergence.divergence_audit(rows_of(spark, mixed), min_docs=6, top=top).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_audit(mixed, 6, top)


def test_divergence_without_kept_terms_or_rows(spark, mixed):
    assert set(map(tuple, divergence.divergence_audit(rows_of(spark, mixed), min_docs=10_000).collect())) == brute_audit(mixed, 10_000, 50)
    assert divergence.divergence_audit(rows_of(spark, mixed[:0])).count() == 0


def test_long_texts_count_as_short_ones(monkeypatch):
    import pyarrow as pa

    text = ("Alpha beta,gamma\n日本 " * 300 + "end").encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array([b"alpha", text, b""], pa.binary())], names=["lang", "source", "raw"])
    counted = lambda: sum((collections.Counter({(r["term"], k): r[k] for r in b.to_pylist() for k in ("n", "docs")}) for b in divergence._count_batch(batch)), collections.Counter())
    whole = counted()
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert counted() == whole and whole["alpha", "n"] == 301 and whole["alpha", "docs"] == 2


def brute_lloyd(rows, k, rounds, dims):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), tuple(r[1])))
    c = np.array([v for _, v in first[:k]])
    x = np.array([v for _, v in kept])
    near = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        at = near().argmin(axis=1)
        c = np.array([[int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)] if (at == j).any() else c[j] for j in range(len(c))])
    far = near()
    at = far.argmin(axis=1)
    d = far[np.arange(len(x)), at]
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((i, int(a), int(y), int(d[at == a].sum()), int(d.sum()), digest[a]) for (i, _), a, y in zip(kept, at, d)), key=str)


@pytest.mark.parametrize("width,chunk,scale", [(5, 7, 1.0), (8, 4096, 1.0), (3, 50, 4000.0)])
def test_centroids(spark, width, chunk, scale):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in scale * (rng.normal(size=8) + 3 * (k % 4))]) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(60)] + rows[:3]  # a vector that is often repeated, and repeated rows
    rows += [(None, rows[5][1]), (None, rows[6][1]), (300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, chunk string")
    got = clustering.cluster_report(df, k=9, rounds=3, dims=8, width=width, most=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute_lloyd(rows, 9, 3, 8)


def test_few_vectors_none_and_too_large_ones(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(1, [1.0, 2.0]), (2, [3.0, -1.0])]
    got = clustering.cluster_report(spark.createDataFrame(few, schema), k=5, rounds=2, dims=2, width=1).collect()
    assert sorted(map(tuple, got), key=str) == brute_lloyd(few, 5, 2, 2)
    assert clustering.cluster_report(spark.createDataFrame([(1, None)], schema), dims=2).count() == 0
    assert (2 * clustering.largest(64)) ** 2 * 64 < 1 << 63 <= (2 * clustering.largest(64) + 2) ** 2 * 64
    with pytest.raises(Exception, match="no long holds"):
        clustering.cluster_report(spark.createDataFrame([(1, [1e30, 0.0])], schema), k=1, rounds=0, dims=2).collect()


def test_statistics_of_pieces_are_those_of_the_whole(monkeypatch):
    texts = ["", "a", "One two two THREE!! | x### 12, é.\nsame\nsame\n" * 40, "x" * 500, " \n ", "A A A"]
    whole = [pu_quality.statistics(t.encode()) for t in texts]
    assert all(len(x) == pu_quality.INPUTS and np.isfinite(x).all() for x in whole)
    monkeypatch.setattr(pu_quality, "PIECE", 37)
    assert [pu_quality.statistics(t.encode()) for t in texts] == whole


def _auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_quality_of_the_synthetic_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    vectors = pu_quality.text_vectors(docs, labels)
    model = pu_quality.fit(vectors)
    true = labels.where("doc_id is not null").agg(F.avg("quality")).first()[0]
    assert abs(model["prior"] - true) < 0.04
    got = pu_quality.quality_scores(docs, labels).join(labels, F.col("own_id") == F.col("doc_id")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and r.predicted == (r.score >= 0.3) for r in got)
    for lang in ("en", "de", "fr", "es"):
        y, s = (np.array([r[c] for r in got if r.lang == lang]) for c in ("quality", "score"))
        assert _auc(y, s) > 0.97 and ((s >= 0.3) == y).mean() > 0.97, lang


def test_held_out_labels_and_other_columns_change_no_score(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        w = [rng.choice(["tree", "house", "river,", "stone."]) for _ in range(rng.randint(5, 60))]
        rows.append((k, " ".join(x.upper() + "!!" for x in w) if k % 5 == 0 else " ".join(w), "en", "s"))
    rows += [(None, None, None, None), (None, "text", "en", "s"), (900, "", "de", "s"), (901, "tree " * 300_000, "en", "s"), (3, rows[3][1], "en", "s")]
    df = rows_of(spark, rows)
    labels = [(k, int(k % 5 != 0)) for k in range(0, 300, 2)] + [(2, None), (4, 0), (4, 1), (None, 1), (5000, 1)]
    schema = "doc_id bigint, quality int"
    score = lambda d, lab: sorted(map(tuple, pu_quality.quality_scores(d, lab).collect()), key=str)
    got = score(df, spark.createDataFrame(labels, schema))
    assert len(got) == len(rows) and all(0 <= r[2] <= 1 for r in got)
    flipped = [(i, q if i is None or zlib.crc32(str(i).encode()) % 5 else 1 - (q or 0)) for i, q in labels]
    assert [(r[0], round(r[2], 4)) for r in score(df.select("doc_id", "text"), spark.createDataFrame(flipped, schema))] == [(r[0], round(r[2], 4)) for r in got]
    right = [(r[3] == 1) == (r[0] % 5 != 0) for r in got if r[0] is not None and r[0] < 300]
    assert sum(right) > 0.97 * len(right)
    assert {r[2] for r in score(df, spark.createDataFrame([], schema))} == {0.5}
    assert score(df.limit(0), spark.createDataFrame(labels, schema)) == []
