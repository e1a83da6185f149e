import random

from pyspark.sql import functions as F

from tally.llm import mixing


def test_toxic_rows_of_a_small_language_are_recalled(spark):
    rng = random.Random(5)
    vocabulary = {"en": ["tree", "house", "river", "stone", "cloud", "light"], "de": ["Baum", "Haus", "Fluss", "Stein", "Wolke", "Licht"]}
    nasty, docs, labels = {"en": "nasty", "de": "garstig"}, [], []
    for lang, n in (("en", 1200), ("de", 60)):
        for k in range(n):
            toxic = k % 4 < 2
            w = [rng.choice(vocabulary[lang]) for _ in range(30)]
            if toxic:
                w[::9] = [nasty[lang]] * len(w[::9])
            docs.append((len(docs), " ".join(w), lang))
            labels.append((len(labels), 1, int(toxic), k % 2 == 0))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, fit boolean")
    model = mixing.fit_classifier(df, lab.where("fit"))
    p = F.get("p", F.lit(mixing.DOMAINS.index("toxic")))
    got = mixing.posteriors(df, model).select("id", p.alias("p")).join(lab.where("not fit"), F.col("id") == F.col("doc_id")).join(df.select("doc_id", "lang"), "doc_id").collect()
    for lang in vocabulary:
        mine = [r for r in got if r.lang == lang]
        assert all((r.p > 0.5) == bool(r.toxic) for r in mine) and {r.toxic for r in mine} == {0, 1}
    # Neither the fit nor the posteriors read the language.
    assert mixing.posteriors(df.drop("lang"), mixing.fit_classifier(df.drop("lang"), lab)).count() == len(docs)


def test_held_out_labels_of_the_synthetic_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_classifier(docs, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), mixing.domain_label(F.col("quality"), F.col("toxic")).alias("domain"))
    got = mixing.posteriors(docs, model).join(truth, "id").select("domain", "p").collect()
    hit = {d: [r.p[k] == max(r.p) for r in got if r.domain == d] for k, d in enumerate(mixing.DOMAINS)}
    share = {d: sum(h) / len(h) for d, h in hit.items()}
    assert share["clean"] >= 0.95 and share["low"] >= 0.6 and sum(map(sum, hit.values())) >= 0.85 * len(got), share
