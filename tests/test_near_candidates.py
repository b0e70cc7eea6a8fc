from docweave.operators import verify
from docweave.plans import link_queries

QUOTE = "the manufacturer shall keep the technical documentation at the disposal of the competent authorities for ten years"


def test_quotes_changed_anywhere(spark):
    held = {"start": QUOTE.replace("manufacturer", "manufacturers"), "third": QUOTE.replace("keep", "kept"), "end": QUOTE.replace("years", "months"), "short": "we say keep it cool here", "none": "nothing of that kind is written here"}
    sources = spark.createDataFrame([(k, f"so: {v} always") for k, v in held.items()], "source_id string, source string")
    quotes = spark.createDataFrame([("long", QUOTE), ("short", "keep it cool"), ("blank", " ")], "quote_id string, quote string")
    near = verify.near_grounding(verify.candidates(quotes, sources)).filter("near").collect()
    assert {(r.quote_id, r.source_id) for r in near} == {("long", "start"), ("long", "third"), ("long", "end"), ("short", "short")}
    exact = {r.quote_id: (r.verdict, r.n) for r in verify.grounding(quotes, sources).collect()}
    assert exact == {"long": ("absent", 0), "short": ("exact", 1), "blank": ("absent", 0)}


def test_no_near_pair_is_missed(spark, sf_dir):
    documents = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.quote_id, r.source_id) for r in link_queries.near_quotes(spark, sf_dir).filter("near").collect()}
    want = set()
    for r in items:
        w = r.text.split(" ")
        for place, quote in (("start", [w[0], "more", *w[2:]]), ("middle", [*w[: len(w) // 3], "more", *w[len(w) // 3 + 1 :]]), ("end", [*w, "more"])):
            for i, text in documents:
                recall, block = verify.nearness(" ".join(quote), text) if sum(x in text for x in w) > len(w) / 2 else (0, 0)
                if recall >= 0.9 and block >= 0.6:
                    want.add((f"{r.item_id}:{place}", i))
    ids = {str(r.item_id) for r in items}
    assert {x for x in got if x[0].split(":")[0] in ids} == want
    assert {x[0].split(":")[1] for x in want} == {"start", "middle", "end"}
