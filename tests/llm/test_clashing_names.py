"""Tables with columns named like those that operators add or use inside."""

from pyspark.sql import functions as F

from docweave.llm import bpe, language, minhash, mixing, pii, toxicity, urls

NAMES = "ids bytes spans score lang_pred n_shingles component_id kept n one two bands id band label hash fold blob word weight rate copy held_out verdict template".split()


def table(spark):
    rows = spark.createDataFrame([(1, "the a@b.cd text of some words here", "en", "s"), (2, "the a@b.cd text of some words here", "en", None), (3, None, None, "s")], "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit(name).alias(name) for name in NAMES])


def test_all(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for got, added in (
        (bpe.decode(bpe.encode(docs)), {"ids", "bytes"}),
        (pii.find(docs), {"spans"}),
        (pii.mask(docs), set()),
        (toxicity.score(docs, labels), {"score"}),
        (language.identify(docs, docs.select("doc_id", "text", "lang")), {"lang_pred", "score"}),
        (minhash.near_duplicates(docs), {"n_shingles", "component_id", "kept"}),
        (minhash.drop_duplicates(docs), set()),
        (mixing.mix(docs, copy="copy"), {"copy"}),
        (urls.judge(docs.withColumn("url", F.lit("http://a.net/x")).withColumnRenamed("doc_id", "page_id")), {"verdict", "template"}),
    ):
        assert len(set(got.columns)) == len(got.columns)
        for r in got.collect():
            for name in set(NAMES) & set(got.columns) - added:
                assert r[name] == name
