import base64
import collections
import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tally.llm import mixing, quality  # noqa: E402
from tests.llm.test_operators import brute_links, lower  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The synthetic tables with odd rows and columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {c: f"'{c}'" for c in ("row", "id", "kept", "times", "nth", "single")}
    docs = docs.selectExpr("*", *[f"{v} AS `{c}`" for c, v in extra.items()])
    odd = docs.where("doc_id < 12")
    nulls = odd.selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[c for c in docs.columns if c != "doc_id"])
    blank = odd.selectExpr("doc_id + 5000 AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '' END AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", *docs.columns[4:])
    long = odd.where("doc_id = 1").selectExpr("CAST(9000 AS BIGINT) AS doc_id", "repeat(concat(text, ' '), 400) AS text", *docs.columns[2:])
    path = tmp_path_factory.mktemp("tables")
    docs.unionByName(odd).unionByName(nulls).unionByName(blank).unionByName(long).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    import tiktoken

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{folder}/labels.parquet")
    pair = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    before, stages = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, folder), "t")
        stages.append((before, docs))
        assert name == "byte-level BPE" or docs.columns == columns

    # The verdict itself is compared with a brute-force estimate in test_operators.
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(stages[0][0]).where("doc_id is not null").collect()}
    rows, kept = (pair(df) for df in stages[0])
    assert {k: n for k, n in kept.items() if k[0] is not None} == {k: n for k, n in rows.items() if k[0] is not None and verdict[k[0]]}

    groups = collections.defaultdict(list)
    for (i, t), _ in pair(stages[1][0]).items():
        groups[lower(t)].append((i is not None, i or 0, t))
    assert pair(stages[1][1]) == {(max(g)[1] if max(g)[0] else None, max(g)[2]): 1 for g in groups.values()}

    rows = [k for k in pair(stages[2][0])]
    assert all(i is not None for i, _ in rows)
    assert sorted(i for i, _ in pair(stages[2][1])) == sorted(i for i, (_, c) in brute_links(rows, 5, 80, 100).items() if i == c)

    rates = {r.own_id: (r.rate, r.p) for r in mixing._rated(stages[3][0], labels, "doc_id", "text", None, "clean").collect()}
    times = pair(stages[3][1])
    for i, t in pair(stages[3][0]):
        assert 0 <= times[i, t] - int(rates[i][0]) <= 1
    kept = {i for i, _ in times}
    assert all(i in kept and rates[i][0] == 1 for i, (_, p) in rates.items() if p[0] >= max(p))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for (i, t), n in times.items():
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert collections.Counter(tuple(r) for r in stages[4][1].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
