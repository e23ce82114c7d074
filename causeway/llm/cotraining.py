"""Quality classifier by co-training: one model sees the text, one the metadata, each teaches the other.

Target: a document is good if it is labelled of good quality and not toxic. The text view has
character classes, repetition and the presence of telling words; the metadata view has language, source and
length, alone and in pairs. Both are logistic models. They start from labelled rows. In each round each view ranks all other documents
and labels those at both ends of its ranking, for the other view to learn from; how many of the labelled rows kept aside
are right at that end of the ranking tells whether the view may teach that label. At last each view is
calibrated on the rows kept aside, a third logistic model combines the two, and every document is scored.

Documents are read twice: for the labelled rows' features, and for compact features of all rows, which go to the shared folder
(about 200 bytes a row). Rounds and scores read these only. A round sends to the driver a histogram of both rankings and ``teach`` rows for each
label and view, somewhat more where many rows have one rank; a hash of the row decides among these.

Bounds, all parameters: at most ``labelled`` labelled rows are used to fit, the first by a hash of the id; all other rows count as
unlabelled. The telling words are the ``words`` best by their chi-square. Rankings and scores cover all rows.

Defined results: null texts count as empty, null metadata as a value of its own. Labels of one id are merged (worst counts); null
labels are not used. Without labels of both kinds every score is 0.5 and every document is kept. Repeated rows
each give a row; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.quality import CLASSES, histograms, repeated_words
from causeway.runtime import ship, stored

_BARE = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
SOURCE_BINS, LANG_BINS, SIZE_BINS, PAIR_BINS = 32, 16, 24, 256
#: Steps of a ranking within one unit of the margin, and the largest margin told apart.
STEPS, WIDEST = 20, 20


@dataclass(frozen=True)
class CoTraining:
    labelled: int = 6000
    words: int = 800
    rounds: int = 4
    #: Share of right labels among the kept-aside rows that a view must have at the end of its ranking.
    sure: float = 0.9
    teach: int = 300
    keep_from: float = 0.5


def style(text: str) -> np.ndarray:
    """Shares of character classes and common words, repetition, length of words and lines."""
    raw = text.encode("utf-8", "replace")
    chars, common = histograms(raw)
    split = raw.split()
    n, lines = max(1, len(split)), [x for x in raw.split(b"\n") if x.strip()]
    extra = [repeated_words(split, 8) / n, len(set(split)) / n, len(raw) / n / 10, np.log1p(len(split)) / 10, 1 - len(set(lines)) / max(1, len(lines)), common[:-1].sum() / max(1, common.sum())]
    return np.concatenate([chars / max(1, chars.sum()), extra])


N_STYLE = CLASSES + 6


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Places of the bins: language, source, length (an eighth of a power of ten), and the three pairs of these."""
    size = SIZE_BINS - 1 if n_chars is None else min(SIZE_BINS - 2, int(np.log10(max(0, n_chars) + 1) * 4))
    own = (zlib.crc32((lang or "\0").encode()) % LANG_BINS, zlib.crc32((source or "\0").encode()) % SOURCE_BINS, size)
    pairs = [zlib.crc32(f"{k} {own[i]} {own[j]}".encode()) % PAIR_BINS for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))]
    singles = (own[0], LANG_BINS + own[1], LANG_BINS + SOURCE_BINS + own[2])
    return np.array([*singles, *(N_SINGLE + x for x in pairs)], np.uint16)


N_SINGLE = LANG_BINS + SOURCE_BINS + SIZE_BINS
N_META = N_SINGLE + PAIR_BINS


def words_of(text: str) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct words."""
    return np.unique(np.fromiter(map(zlib.crc32, set(text.encode("utf-8", "replace").translate(_BARE).split())), np.uint32))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    beta = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], ridge)
    damp[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - damp * beta
        h = ((x * (w * p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ x).astype(float) + np.diag(damp)
        move = np.linalg.solve(h, g)
        beta += move * min(1.0, 5.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    return beta


def margin(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


@dataclass
class Views:
    """Fitted models: telling words, scale of the style features, weights of both views and of their combination."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_STYLE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_STYLE))
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    text_line: tuple[float, float] = (1.0, 0.0)
    meta_line: tuple[float, float] = (1.0, 0.0)
    both: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def told(self, found: np.ndarray) -> np.ndarray:
        """Places of the telling words among those found."""
        if not len(self.words):
            return np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        return at[self.words[at] == found]

    def compact(self, shape: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled style and places of the telling words."""
        return np.clip((shape - self.mean) / self.scale, -8, 8).astype(np.float32), self.told(found).astype(np.uint16)

    def text_rows(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(rows), N_STYLE + len(self.words)), np.float32)
        for k, (shape, told) in enumerate(rows):
            x[k, :N_STYLE] = shape
            x[k, N_STYLE + told.astype(int)] = 1
        return x

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated scores of each view and of both, from margins."""
        if self.text is None:
            return np.full((3, len(a)), 0.5)
        a, b = self.text_line[0] * a + self.text_line[1], self.meta_line[0] * b + self.meta_line[1]
        c = self.both[0] * a + self.both[1] * b + self.both[2]
        return 1 / (1 + np.exp(-np.clip(np.stack([a, b, c]), -50, 50)))


def meta_rows(places: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(places), N_META), np.float32)
    for k, p in enumerate(places):
        x[k, p.astype(int)] = 1
    return x


def telling(found: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The words (hashes, sorted) whose presence says most about ``y``, by chi-square; seen in three rows at least."""
    words, place = np.unique(np.concatenate(found), return_inverse=True)
    labels = np.repeat(y, [len(f) for f in found])
    a, b = np.bincount(place, labels, len(words)), np.bincount(place, 1 - labels, len(words))
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    share = (a + b) / (n1 + n0)
    chi = (a - n1 * share) ** 2 / (n1 * share) + (b - n0 * share) ** 2 / (n0 * share)
    chi[a + b < 3] = -1
    best = np.lexsort((words, -chi))[:most]
    return np.sort(words[best[chi[best] >= 0]])


#: A row as both views see it: (style, telling words) and metadata.
Seen = tuple[tuple[np.ndarray, np.ndarray], np.ndarray]
#: Of a round: view and label to the rows at that end of the ranking, by key.
Surest = Callable[[Views, int], dict[tuple[str, int], dict[int, Seen]]]


def begun(rows: list[dict], spec: CoTraining) -> Views:
    """Telling words and scale of the style, from labelled rows that are not kept aside."""
    y = np.array([r["label"] for r in rows], float)
    if len(rows) < 10 or y.min() == y.max():
        return Views()
    learn = np.arange(len(rows)) % 4 != 3
    v = Views(telling([r["words"] for r, k in zip(rows, learn) if k], y[learn], spec.words))
    shapes = np.array([r["style"] for r in rows])[learn]
    v.mean, v.scale = shapes.mean(0), shapes.std(0) + 1e-6
    return v


def fit(rows: list[dict], v: Views, surest: Surest, spec: CoTraining = CoTraining()) -> dict[str, int]:
    """Fits ``v``. ``rows``: style, words, meta and label. Gives how many labels each view was taught."""
    y = np.array([r["label"] for r in rows], float)
    aside = np.arange(len(rows)) % 4 == 3
    x = {"text": v.text_rows([v.compact(r["style"], r["words"]) for r in rows]), "meta": meta_rows([r["meta"] for r in rows])}
    base, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    taught: dict[str, dict[int, tuple[Seen, float]]] = {"text": {}, "meta": {}}
    for step in range(spec.rounds + 1):
        for view in ("text", "meta"):
            more = [t[0] for t in taught[view].values()]
            own = v.text_rows([m[0] for m in more]) if view == "text" else meta_rows([m[1] for m in more])
            target = np.concatenate([y[base], [t[1] for t in taught[view].values()]])
            weight = np.concatenate([np.ones(len(base)), np.full(len(more), 0.5)])
            setattr(v, view, logistic(np.concatenate([x[view][base], own]), target, weight, ridge=4.0))
        if step == spec.rounds:
            break
        most = spec.teach * (step + 1)
        found = surest(v, most)
        for (view, label), some in found.items():
            own = margin(x[view][held], getattr(v, view)) * (1 if label else -1)
            top = np.argsort(-own, kind="stable")[: max(5, len(held) // 10)]
            if (y[held][top] == label).mean() >= spec.sure:
                taught["meta" if view == "text" else "text"].update({k: (seen, float(label)) for k, seen in sorted(some.items())})
    a, b = margin(x["text"][held], v.text), margin(x["meta"][held], v.meta)
    ones = np.ones(len(held))
    v.text_line = tuple(logistic(a[:, None], y[held], ones))
    v.meta_line = tuple(logistic(b[:, None], y[held], ones))
    pair = np.stack([v.text_line[0] * a + v.text_line[1], v.meta_line[0] * b + v.meta_line[1]], 1)
    v.both = tuple(logistic(pair, y[held], ones))
    return {view: len(t) for view, t in taught.items()}


_SAMPLE = "label int, style binary, words binary, meta binary"
_COMPACT = "doc_id long, style binary, told binary, meta binary"
_MARGINS = _COMPACT + ", text_margin double, meta_margin double"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        meta = [metadata(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
        raw = [[x.tobytes() for x in c] for c in (map(style, texts), map(words_of, texts), meta)]
        yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(c, pa.binary()) for c in raw)], ["label", "style", "words", "meta"])


def labelled_rows(docs: DataFrame, labels: DataFrame, spec: CoTraining) -> tuple[list[dict], list[int]]:
    """Features and labels of a bounded, documented sample of labelled rows, and their ids."""
    good = (F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    merged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(good.cast("int").alias("label"))
    known = stored(docs.where("doc_id is not null").select("doc_id").distinct().join(merged, "doc_id"), "labels")
    # rows that cannot be among the first go before the sort, so that no task sends more than its share
    share = min(1.0, 2 * spec.labelled / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = stored(known.where(place < int(share * (1 << 20)) + 1).orderBy(place, "doc_id").limit(spec.labelled), "chosen")
    # of rows of one id the smallest
    own = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    rows = own.select("label", "row.*").mapInArrow(_featured, _SAMPLE).collect()
    rows = sorted(rows, key=lambda r: (bytes(r["words"]), bytes(r["style"]), bytes(r["meta"])))
    of = lambda raw, kind=np.float64: np.frombuffer(bytes(raw), kind)
    order = np.random.default_rng(5).permutation(len(rows)).tolist()
    some = [{"label": rows[k]["label"], "style": of(rows[k]["style"]), "words": of(rows[k]["words"], np.uint32), "meta": of(rows[k]["meta"], np.uint16)} for k in order]
    return some, [r["doc_id"] for r in chosen.select("doc_id").collect()]


def _compacted(views):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = views.value
        for b in batches:
            cols: list[list[bytes]] = [[], [], []]
            for text, *meta in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))):
                shape, told = v.compact(style(text or ""), words_of(text or ""))
                for c, x in zip(cols, (shape, told, metadata(*meta))):
                    c.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.binary()) for c in cols)], [x.split()[0] for x in _COMPACT.split(", ")])

    return run


def _seen(style_: bytes, told: bytes, meta: bytes) -> Seen:
    return (np.frombuffer(style_, np.float32), np.frombuffer(told, np.uint16)), np.frombuffer(meta, np.uint16)


def _with_margins(views, scored: bool):
    """Margins of both views; or, at last, calibrated scores and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, keep_from = views.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows = [_seen(*x) for x in zip(*(part.column(c).to_pylist() for c in ("style", "told", "meta")))]
                if v.text is None:
                    a = m = np.zeros(len(rows))
                else:
                    a, m = margin(v.text_rows([r[0] for r in rows]), v.text), margin(meta_rows([r[1] for r in rows]), v.meta)
                if scored:
                    s = v.scores(a, m)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, s), pa.array(s[2] >= keep_from)], [x.split()[0] for x in _OUT.split(", ")])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a), pa.array(m)], [x.split()[0] for x in _MARGINS.split(", ")])

    return run


def surest_of(features: DataFrame, spec: CoTraining) -> Surest:
    """The rows of ``features`` at both ends of both rankings, by two passes: histograms, then rows."""

    def surest(v: Views, most: int) -> dict[tuple[str, int], dict[int, Seen]]:
        views = features.sparkSession.sparkContext.broadcast((v, spec.keep_from))
        rows = features.mapInArrow(_with_margins(views, False), _MARGINS)
        step = lambda view: F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col(f"{view}_margin"))) * STEPS).cast("int")
        rows = rows.withColumns({"text_step": step("text"), "meta_step": step("meta"), "key": F.xxhash64("doc_id", "style", "told", "meta")})
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("view"), F.col(f"{x}_step").alias("step")) for x in ("text", "meta")]))
        sums = rows.select(each.alias("x")).groupBy("x.view", "x.step").count().collect()
        wanted = {}
        for view in ("text", "meta"):
            for label in (1, 0):
                sign, left, test = (1 if label else -1), most, F.lit(False)
                for r in sorted((r for r in sums if r["view"] == view), key=lambda r: -sign * r["step"]):
                    whole = r["count"] <= left
                    share = F.lit(True) if whole else F.pmod("key", F.lit(1 << 30)) < int(left / r["count"] * (1 << 30))
                    test = test | (F.col(f"{view}_step") == r["step"]) & share
                    left -= r["count"]
                    if left <= 0:
                        break
                wanted[view, label] = test
        flags = F.array(*[F.when(t, F.lit(f"{view} {label}")) for (view, label), t in wanted.items()])
        got = rows.select("key", "style", "told", "meta", F.array_compact(flags).alias("ends")).where(F.size("ends") > 0)
        out: dict[tuple[str, int], dict[int, Seen]] = {k: {} for k in wanted}
        for r in got.collect():
            for end in r["ends"]:
                view, label = end.split()
                out[view, int(label)][r["key"]] = _seen(bytes(r["style"]), bytes(r["told"]), bytes(r["meta"]))
        return out

    return surest


_OUT = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def trained(docs: DataFrame, labels: DataFrame, spec: CoTraining) -> tuple[Views, DataFrame, dict[str, int]]:
    """Fitted views, compact features of all rows, and how many labels each view was taught."""
    context = docs.sparkSession.sparkContext
    rows, ids = labelled_rows(docs, labels, spec)
    v = begun(rows, spec)
    features = stored(docs.mapInArrow(_compacted(context.broadcast(v)), _COMPACT), "features")
    if len(rows) < 10 or len({r["label"] for r in rows}) < 2:
        return v, features, {"text": 0, "meta": 0}
    fitted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    return v, features, fit(rows, v, surest_of(features.join(fitted, "doc_id", "left_anti"), spec), spec)


def classify(documents: DataFrame, labels: DataFrame, spec: CoTraining = CoTraining()) -> DataFrame:
    """One row for each document: doc_id, calibrated score of each view, combined score, verdict."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    v, features, _ = trained(docs, labels, spec)
    return features.mapInArrow(_with_margins(spark.sparkContext.broadcast((v, spec.keep_from)), True), _OUT)
