import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(6)
    words = "the of and to in a is that it for was on are as with house river garden stone bread light music morning".split()
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(9)) * (r.random() < 0.3) for _ in range(n)) + "."
    items = [(1, text(30)), (2, text(30))]
    docs = {k: text(r.randint(60, 200)) for k in range(80)}
    docs[80] = docs[3]
    docs[81] = docs[5].replace("the", "thee", 1)
    docs[82] = text(60) + " " + items[0][1]
    docs[83] = text(50) + " mail joe@mail.example.com now"
    docs[84] = "too short"
    docs[85] = "BUY!! " + " ".join(f"NOW{k}!!" for k in range(90))
    docs[86] = None
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long, sig string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = kept.columns
    expect = [{84, 85, 86}, {80, 81}, {82}, set(), set()]
    for (name, stage), gone in zip(corpus_pipeline.STAGES, expect):
        before = {x["doc_id"] for x in kept.collect()}
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert before - {x["doc_id"] for x in kept.collect()} == gone, name
        if name != "bpe":
            assert kept.columns == columns
        if name == "pii":
            row = kept.where("doc_id = 83").first()
            assert "joe@" not in row["text"] and row["text"].endswith("mail [PII] now") and row["n_chars"] == len(row["text"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == set(range(80)) | {83}
    assert all(len(x["ids"]) == x["n_tokens"] > 0 for x in out)
