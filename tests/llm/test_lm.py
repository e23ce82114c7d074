import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from causeway.llm import lm


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def corpus(n=160):
    r = random.Random(2)
    follow = {k: r.sample(range(60), 3) for k in range(60)}
    texts = [None, "", "  ", "unseen" * 30 + " é x", "The the THE"]
    while len(texts) < n:
        k, out = r.randrange(60), []
        for _ in range(r.randint(1, 120)):
            out.append(f"w{k}" if r.random() < 0.95 else f"rare{r.randrange(500)}")
            k = r.choice(follow[k])
        texts.append(" ".join(out))
    return list(enumerate(texts))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 70)
    rows = corpus()
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    spec = lm.LogBilinear(heads=50, class_size=16, spellings=7, size=8, batch=64, rate=0.2, shard_tokens=3000)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {r["doc_id"]: r for r in lm.scores(df, spec).collect()}
    assert len(got) == len(rows)
    model, unigram = 0.0, 0.0
    for i, t in rows:
        w, r = tokens(t), got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        if r["held_out"]:
            model, unigram = model + r["score"], unigram + r["base_score"]
    assert model > unigram  # successors are predictable here
    again = {r["doc_id"]: r for r in lm.scores(df.orderBy(df.doc_id.desc()).repartition(2), spec).collect()}
    for i, r in got.items():
        assert math.isclose(again[i]["score"], r["score"], rel_tol=1e-5) and again[i]["n_known"] == r["n_known"]


def test_probabilities_sum_to_one():
    spec = lm.LogBilinear(heads=7, class_size=3, spellings=2, size=4)
    known = [(f"k{k}".encode(), 20 - k) for k in range(9)]
    rest = {k: (sum(n + 4 for w, n in known if lm.spelling(w, spec) == k), sum(lm.spelling(w, spec) == k for w, _ in known) + 4) for k in range(2)}
    v = lm.Vocabulary.of(known, rest, 5, spec)
    p = lm.Parameters.start(v)
    p.rows[:] += np.random.default_rng(1).normal(0, 0.5, p.rows.shape)
    for a in range(v.end + 1):
        t = np.array([[x, a, (a * 3) % (v.end + 1)] for x in range(v.end + 1)])
        assert math.isclose(np.exp(p.logs(t, v).astype(float)).sum(), 1, rel_tol=1e-4)
    assert list(v.numbers([b"k0", b"k8", b"new"])[0]) == [0, 8, -1]
    assert v.numbers([b"k8"])[1][0] == 7 + lm.spelling(b"k8", spec)


def test_shares_of_a_spelling(spark):
    """Words that are no heads share their class by smoothed counts, a word without count included."""
    texts = ["a a a a b b c c", "a b d", "a a e f"]
    rows = [(i, t) for i, t in zip((k for k in range(50) if zlib.crc32(str(k).encode()) % 7 != 2), texts)]
    probe = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    spec = lm.LogBilinear(heads=2, class_size=2, spellings=1, size=2)
    df = spark.createDataFrame([*rows, (probe, "c zz"), (None, "c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.scores(df, spec).collect()}
    assert got[probe]["n_known"] == 2 and got[probe]["held_out"]
    assert got[probe]["score"] < got[None]["score"] < 0


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b zz"), (1, "a b zz"), (1, "a c"), (None, "a"), (None, None)], "doc_id long, text string")
    got = lm.scores(df, lm.LogBilinear(heads=2, class_size=2, batch=8)).collect()
    assert len(got) == 5
    same = [r for r in got if r["doc_id"] == 1 and r["n_tokens"] == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert lm.scores(df.limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.scores(spark.createDataFrame([(only, "a")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["base_score"], r["score"], r["n_known"]) == (0, 0.0, 0.0, 0)


def test_scores_of_large_products_and_few_rows():
    from types import SimpleNamespace
    import pyarrow as pa

    spec = lm.LogBilinear(heads=4, class_size=2, spellings=3, size=2)
    known = [(b"a", 9), (b"b", 7), (b"c", 5), (b"d", 3)]
    v = lm.Vocabulary.of(known, {k: (40, 9) for k in range(3)}, 2, spec)
    t = np.array([[k, 1, 2] for k in range(v.end + 1)])
    for scale in (1, 60):  # the second has products beyond the exponentials of single precision
        p = lm.Parameters.start(v)
        p.rows[:] = np.random.default_rng(1).normal(0, 1, p.rows.shape) * scale
        h = (p.q[1] @ p.c[0] + p.q[2] @ p.c[1]).astype(float)
        soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
        of_class = soft(p.u @ h + p.bu)
        within = np.concatenate([soft(p.w[k : k + 2] @ h + p.bw[k : k + 2]) for k in (0, 2)])
        want = of_class[v.class_of[t[:, 0]]] + np.where(t[:, 0] < 4, within[np.minimum(t[:, 0], 3)], 0)
        assert np.allclose(p.logs(t, v), want, rtol=1e-4, atol=1e-4)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b odd odd even", None])], ["doc_id", "text"])
    rows = [r for b in lm._scored(SimpleNamespace(value=(v, lm.Parameters.start(v).rows, 0.3, True)))(iter([docs])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n_tokens"], r["words"], r["times"]) for r in rows] == [(1, 6, [b"odd", b"even"], [2, 1]), (2, 1, [], [])]


def test_totals_over_classes_once_for_each_pair_of_words_before(monkeypatch):
    spec = lm.LogBilinear(heads=6, class_size=3, spellings=2, size=4)
    v = lm.Vocabulary.of([(f"k{k}".encode(), 20 - k) for k in range(6)], {k: (200, 9) for k in range(2)}, 5, spec)
    p = lm.Parameters.start(v)
    p.rows[:] += np.random.default_rng(1).normal(0, 0.5, p.rows.shape)
    t = np.random.default_rng(2).integers(0, v.end + 1, (3000, 3))
    widths, totals = Counter(), lm._log_totals

    def counted(s, plain):
        widths[s.shape[1]] += len(s)
        return totals(s, plain)

    alone = np.array([p.logs(x[None], v)[0] for x in t[:200]])
    monkeypatch.setattr(lm, "_log_totals", counted)
    assert np.allclose(p.logs(t, v)[:200], alone, rtol=1e-5, atol=1e-5)
    assert widths[len(v.class_counts)] == len(np.unique(t[:, 1:], axis=0)) <= (v.end + 1) ** 2


def test_sums_by_place():
    r = np.random.default_rng(3)
    at, values = r.integers(0, 9, 500), r.normal(0, 1, (500, 4)).astype(np.float32)
    want = np.zeros((12, 4))
    np.add.at(want, at, values)
    assert np.allclose(lm._scattered(at, values.T, 12), want, atol=1e-6)
    assert not lm._scattered(at[:0], values[:0].T, 12).any()
