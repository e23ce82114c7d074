import hashlib
import random
import re

from causeway.llm import decontam


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w = words(text)
    hit, occurring = [0] * len(w), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    occurring.add(item)
                    hit[p : p + n] = [1] * n
    return len(w), sum(hit), occurring


def brute_matches(text, items):
    """All matches of a window's length or more that go no further on either side."""
    w, out = words(text), set()
    for item, t in items:
        v = words(t)
        for p in range(len(w)):
            for k in range(len(v)):
                if p and k and w[p - 1] == v[k - 1]:
                    continue
                n = 0
                while p + n < len(w) and k + n < len(v) and w[p + n] == v[k + n]:
                    n += 1
                if n >= min(13, len(v)):
                    out.add((item, k, p, n))
    return out


def made(r, size):
    vocab = ["a", "b", "c", "The", "é", "x1", "z_"][:size]
    text = lambda sizes: " ".join(r.choice(vocab) for _ in range(r.choice(sizes)))
    items = [(str(k), text([0, 1, 3, 13, 14, 20, 30])) for k in range(r.randint(0, 4))]
    texts = [None, "", *(text([0, 5, 13, 40, 80]) + r.choice(["", " " + items[0][1] if items else ""]) for _ in range(6))]
    return items, texts


def test_scan_against_brute_force():
    r = random.Random(3)
    for _ in range(120):
        items, texts = made(r, r.choice([2, 3, 5, 7]))
        test = decontam.Lookup(decontam.Block.of(items))
        for t, f in zip(texts, decontam.scan(texts, test)):
            assert (f.words, sum(b - a for a, b in f.spans), {m[0] for m in f.matches}) == brute(t, items)
            assert sorted(f.matches) == sorted(brute_matches(t, items))


def test_matches_of_repeated_words_in_steps(monkeypatch):
    monkeypatch.setattr(decontam, "STEP", 50)
    items = [("a", "w " * 40), ("b", "w w v"), ("c", " ".join(f"n{k}" for k in range(30)))]
    texts = ["w " * 100, "v w w v w", items[2][1] + " end " + items[2][1], " ".join(f"n{k}" for k in range(5, 25))]
    for t, f in zip(texts, decontam.scan(texts, decontam.Lookup(decontam.Block.of(items)))):
        assert sorted(f.matches) == sorted(brute_matches(t, items))
    assert [m[3] for m in f.matches] == [20]


def test_long_document_with_one_passage(spark):
    """One passage in a long text is no twentieth of it; the stage removes the document, the verdict of the query stays."""
    passage = " ".join(f"q{k}" for k in range(20))
    long = "plain words " * 2000
    docs = spark.createDataFrame([(1, long + passage + " " + long, 0), (2, long, 0)], "doc_id long, text string, found int")
    bench = spark.createDataFrame([(5, "before " + passage)], "item_id long, text string")
    assert [r.asDict() for r in decontam.locations(docs, bench).collect()] == [{"doc_id": 1, "item": "5", "item_begin": 1, "begin": 4000, "words": 20}]
    assert [r["contaminated"] for r in decontam.contamination(docs, bench).orderBy("doc_id").collect()] == [False, False]
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).select("doc_id", "found").collect()] == [(2, 0)]
    assert decontam.decontaminate(docs, bench, least_share=0.05).count() == 2


def test_query_with_several_blocks(spark, monkeypatch):
    r = random.Random(5)
    items, texts = made(r, 3)
    items += [(None, " ".join("abc") + " q" * 12), ("9", None), ("7", "word " * 20), ("7", "other " * 20)]
    texts += ["word " * 30, "x other " + "other " * 12, "b " * 4000 + items[0][1]]
    docs = spark.createDataFrame([(k, t, -1) for k, t in enumerate(texts)], "doc_id long, text string, Found int")
    bench = spark.createDataFrame([(None if i is None else int(i), t) for i, t in items], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCKS_A_PASS", 2)
    for size in (32 << 20, 60):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {x["doc_id"]: x for x in decontam.contamination(docs, bench).collect()}
        for k, t in enumerate(texts):
            n, hit, found = brute(t, items)
            ids = sorted(x for x in found if x is not None)
            assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"]) == (n, hit, len(ids))
            assert got[k]["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
            assert got[k]["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {k for k in got if not got[k]["n_hit"]}
    assert {x["doc_id"] for x in decontam.decontaminate(docs, bench, least_share=0.05).collect()} == {k for k in got if not got[k]["contaminated"]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).first()["contaminated"] is False
    assert decontam.contamination(docs.limit(0), none).count() == 0
