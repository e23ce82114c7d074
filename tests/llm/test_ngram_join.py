import random
import re

from causeway.llm import ngram_join
from causeway.llm.components import connected
from causeway.llm.ngram_join import Similarity, classes, one_of_each


def brute(rows, size, num, den):
    def grams(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(x), find(i)) for i, x in sets}


def corpus(r, n):
    vocab = [f"w{k}" for k in range(40)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    rows, texts = [], [None, "", " \n", "a b", "A B", "a b c"]
    bases = [[r.choice(vocab) for _ in range(r.choice([5, 20, 60, 150]))] for _ in range(12)]
    while len(texts) < n:
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["x"], [r.choice(vocab), w[k]], [w[k].upper()]])
        texts.append(" ".join(w) + r.choice(["", " " + passage]))
    for k, t in enumerate(texts):
        rows.append((k * 7 % n, t))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_TOTAL", 5)
    r = random.Random(11)
    for short, block, size, num in ((64, 1024, 4, 85), (4, 8, 5, 80), (4, 16, 4, 70)):
        monkeypatch.setattr(ngram_join, "SHORT", short)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        rows = corpus(r, 160)
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in classes(df, Similarity(size, num, 100)).collect()}
        assert got == brute(rows, size, num, 100)


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"v{k}" for k in range(50))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, None, "c"), (9, text, "d"), (4, "other", "e")], "doc_id long, text string, source string")
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in classes(df).collect())
    assert got == [("1", 47, "1"), ("1", 47, "1"), ("4", 1, "4"), ("9", 47, "1"), ("None", 0, "None"), ("None", 47, "None")]
    kept = one_of_each(df, Similarity(5, 80, 100))
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "4", "None", "None"]
    assert kept.columns == df.columns
    ties = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, None, "c"), (2, text + " end", "d"), (7, text, "e"), (7, "other words", "f"), (5, "other words", "g")], "doc_id long, text string, source string")
    assert sorted(tuple(x)[::2] for x in one_of_each(ties, Similarity(5, 80, 100)).collect()) == [(1, "a"), (1, "c")]
    assert classes(df.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {x["node"]: x["comp"] for x in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_frequent_tokens_do_not_depend_on_partitions(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(40)) + " " + passage + (" every text ends so" if k % 2 else "")) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(200)  # a partition has two of them
    tokens, _, place = ngram_join.frequent_tokens(df, Similarity())
    order = dict(zip(tokens.tolist(), place.tolist()))
    common, half = (ngram_join.shingles(t, 4).tolist() for t in (passage, "every text ends so"))
    assert set(common + half) <= set(order)
    assert max(order[t] for t in half) < min(order[t] for t in common)  # the most frequent come last
