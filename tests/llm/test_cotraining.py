import random

from causeway.llm import cotraining
from causeway.llm.cotraining import CoTraining


def corpus(n=400):
    r = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = [r.choice(["house", "river", "garden", "stone", "bread"]) if good else r.choice(["BUY!!", "NOW!!", "CASH$$", "house"]) for _ in range(r.randint(20, 80))]
        text = " ".join(words)
        docs.append((k, text, "en", "a" if good or r.random() < 0.2 else "b", len(text)))
        if k % 2 == 0:
            labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.classify(df, lab, CoTraining(words=50)).collect()}
    assert len(got) == len(docs)
    unseen = [k for k in got if k % 2]
    assert sum(got[k]["kept"] == (k % 3 > 0) for k in unseen) >= 0.95 * len(unseen)
    assert sum((got[k]["meta_score"] >= 0.5) == (k % 3 > 0) for k in unseen) >= 0.7 * len(unseen)
    again = {r["doc_id"]: r for r in cotraining.classify(df.repartition(7), lab, CoTraining(words=50)).collect()}
    assert all(abs(got[k]["score"] - again[k]["score"]) < 1e-6 for k in got)


def separate(n=1200, known=80):
    """Few labels; sources tell good from bad, and so do many words, each a little."""
    r = random.Random(9)
    docs, truth = [], {}
    for k in range(n):
        good = r.random() < 0.5
        side = lambda: r.random() < (0.68 if good else 0.32)
        words = [f"{'ab'[side()]}{chr(97 + r.randrange(25))}" for _ in range(8)] + [f"c{chr(97 + r.randrange(25))}" for _ in range(15)]
        r.shuffle(words)
        right = r.random() < 0.93
        docs.append((k, " ".join(words), "en", f"{'good' if good == right else 'bad'}{r.randrange(2)}", 150 + r.randrange(9)))
        truth[k] = good
    return docs, truth, [(k, int(truth[k]), 0) for k in range(known)]


def test_each_view_teaches_the_other(spark):
    docs, truth, labels = separate()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spec = CoTraining(words=400, rounds=4, teach=100)
    right = {}
    for rounds in (0, 4):
        own = CoTraining(words=400, rounds=rounds, teach=100)
        got = cotraining.classify(df, lab, own).collect()
        right[rounds] = [sum((r[c] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] >= len(labels)) for c in ("text_score", "score")]
    assert right[4][0] > right[0][0] + 0.01 * len(docs) and right[4][1] >= 0.97 * right[0][1]
    _, _, taught = cotraining.trained(df, lab, spec)
    assert taught["text"] > 0 and taught["meta"] > 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "x" * 50000, "en", "s", 5), (None, "a", "de", "t", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, none).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["kept"] for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in cotraining.classify(docs, one).collect())
    assert cotraining.classify(docs.limit(0), one).count() == 0
