from collections import Counter

import pytest
from tokenizers import Tokenizer

from causeway.llm import rollups
from causeway.llm.bpe import located
from causeway.llm.entries import TOKENIZER

PATH = located(TOKENIZER)


def test_counts_against_brute_force(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "two words", "é😀 three words\there", "x" * 3000]
    rows = [(k, t, "a" if k % 2 else None, "en") for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, tokens int")
    got = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in rollups.counted(df, {"words": None, "bpe": PATH}).collect()}
    for k, t in enumerate(texts):
        assert got[k, "words"] == len((t or "").split()) and got[k, "bpe"] == len(lib.encode(t or "", add_special_tokens=False).ids)


def test_batches(spark, tmp_path):
    ledger = rollups.Ledger(spark, str(tmp_path / "l"))
    schema = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"
    batches = {
        "b/1": [("a", "en", "t1", "insert", 10, None), ("a", "en", "t1", "insert", 5, None), (None, None, "t1", "insert", 7, None)],
        "b2": [("a", "en", "t1", "delete", 5, None), ("a", "en", "t1", "revise", 12, 10)],
        "b3": [(None, None, "t1", "delete", 7, None)],
        "empty": [],
    }
    for name, rows in batches.items():
        df = spark.createDataFrame(rows, schema)
        assert ledger.commit(name, df) and not ledger.commit(name, df)
    assert ledger.batches() == sorted(batches)
    want: Counter = Counter()
    for rows in batches.values():
        for s, lang, t, change, n, old in rows:
            want[s, lang, t, "docs"] += {"insert": 1, "delete": -1, "revise": 0}[change]
            want[s, lang, t, "tokens"] += {"insert": n, "delete": -n, "revise": n - (old or 0)}[change]
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollups.Ledger(spark, str(tmp_path / "l")).totals().collect()}
    assert got == {("a", "en", "t1"): (1, 12)} and want["a", "en", "t1", "tokens"] == 12
    with pytest.raises(Exception, match="no such change"):
        ledger.commit("bad", spark.createDataFrame([("a", "en", "t", "upsert", 1, None)], schema))
    assert rollups.Ledger(spark, str(tmp_path / "m")).totals().count() == 0


def test_compaction_and_racing_writers(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long"
    df = spark.createDataFrame([("a", "en", "t", "insert", 3, None)], schema)
    one, two = (rollups.Ledger(spark, str(tmp_path / "l")) for _ in range(2))
    # both have looked for the batch, found none, and written their sums
    folders = [x._written(rollups.signed(df)) for x in (one, two)]
    assert [x._claim("batches", "b", [f]) for x, f in zip((one, two), folders)] == [True, False]
    total = lambda: [tuple(r) for r in rollups.Ledger(spark, str(tmp_path / "l")).totals().collect()]
    assert total() == [("a", "en", "t", 1, 3)]
    assert one.compact() and total() == [("a", "en", "t", 1, 3)]
    assert not two.commit("b", df) and two.commit("c", df) and total() == [("a", "en", "t", 2, 6)]
    stale = two._parts()
    assert one.compact() and not two._claim("generations", str(stale[0] + 1), ["elsewhere"])
    assert total() == [("a", "en", "t", 2, 6)] and one._parts()[2] == ["b", "c"]


def test_maintained_totals_against_brute_force(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    docs = [(k, None if k == 3 else f"some words {k} " * (k % 5), "ab"[k % 2], "en") for k in range(20)] + [(None, "no id", None, None), (4, "again", "a", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    gone = spark.createDataFrame([(4,), (4,), (9,), (None,), (99,)], "doc_id long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollups.maintained(df, gone, {"w": None, "b": PATH}, rollups.Ledger(spark, str(tmp_path / "l"))).collect()}
    want: dict = {}
    for i, t, s, lang in docs:
        if i not in (4, 9):
            for name, n in (("w", len((t or "").split())), ("b", len(lib.encode(t or "", add_special_tokens=False).ids))):
                a, b = want.get((s, lang, name), (0, 0))
                want[s, lang, name] = (a + 1, b + n)
    assert got == want
    assert rollups.maintained(df.limit(0), gone, {"w": None}, rollups.Ledger(spark, str(tmp_path / "m"))).count() == 0
