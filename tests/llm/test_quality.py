import re

import numpy as np
import pytest

from causeway.llm import quality


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    hit = [False] * len(w)
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            hit[k : k + 8] = [True] * 8
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit))
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


GOOD = "The cat and the dog went to the house in the morning, and it was a good day for all of them by the sea. "
TEXTS = [None, "", "short one", GOOD * 1, "a b\x0bc\x1dd é😀   x " * 3, "line\n\nline\n \nline \nline", "r " * 30, (GOOD + "x y z. ") * 4, " ".join(f"w{k}" for k in range(30)), "one two three four five six seven eight " * 2 + " ".join(f"v{k}" for k in range(60))]


def test_base_figures(spark):
    df = spark.createDataFrame([(k, t, "en", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 1)], "doc_id long, text string, lang string, kept int")
    got = quality.verdicts(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:7] == base(TEXTS[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(df.limit(0)).count() == 0


def test_divergence(spark):
    vary = lambda k: " ".join(f"{x}{k}" if i % 9 == 0 else x for i, x in enumerate((GOOD * 3).split()))
    junk = {100: "WITH!! THIS!! " * 3 + " ".join(f"ABC{k}!!" for k in range(60)), 101: " | ".join(f"word{k}" for k in range(80)), 102: " ".join(f"a{k}%%% b{k}$$$" for k in range(50)), 103: "THE!! CAT!! SAT!!"}
    rows = [(k, vary(k), "en") for k in range(60)] + [(k, t, "en") for k, t in junk.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.verdicts(df).collect()}
    assert all(not got[k]["kept"] for k in junk)
    assert all(got[k]["kept"] or got[k]["base_failed"] for k in range(60))
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {k for k, r in got.items() if r["kept"]}


def test_distance():
    assert quality.distance(np.array([1, 1]), np.array([5, 5])) == 0
    assert quality.distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert quality.distance(np.array([0, 0]), np.array([0, 1])) == 0
