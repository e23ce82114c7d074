"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, beside unigram scores.

The model predicts a vector from the vectors of the two words before, one matrix for each place. Its outputs have two levels. The
``heads`` most frequent words of the training texts stand in classes of ``class_size`` by frequency; every further word is in one of
``spellings`` classes by its last two bytes; the end of a text is a class of its own. The product of the predicted vector with the classes'
vectors gives the class, that with the vectors of a class's words the word; both are normalised exactly, by
batched matrix products. A word that is no head has its share of its class's smoothed unigram counts, so that
the probabilities of all words sum to one. Words before that are no heads have the vector of their class.

Counts cover all training documents. Training does too: documents are dealt by a hash of id and text over shards of
about ``shard_tokens`` tokens, whose number comes from the counts. Each shard takes one pass in the order of that hash from the same
start, contrasting classes and words with noise from the unigram distributions; vectors are averaged over shards, in the order of shards,
by how often a shard saw what they stand for. So the model depends on the documents only, not on how they are
partitioned; sums of scores agree up to rounding. What a shard returns is of fixed size. Repeated rows of one id and text teach once.

Counts of the ``KNOWN`` most frequent words are broadcast (a fixed bound); the counts of all others meet the documents
in a join on the word, without hot keys, since those are the broadcast ones.

Defined results: a null text counts as empty; it has one token, the end. A null id counts as the empty string
when documents are divided. Rows of equal id and text each give a row of the same scores. Without training documents
all scores are 0. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.bounded import most_frequent
from causeway.runtime import ship, stored

KNOWN = 100_000
FLUSH = 400_000
END = b""
LONG = 40
#: Rows of parameters that travel together when shards are averaged; tokens scored, and tokens trained, at a time.
CHUNK, SCORED, TAKEN = 2_000, 4_000, 500_000
#: Numbers up to this size, either way, have exponentials that single precision can hold and add up.
PLAIN = 80.0


@dataclass(frozen=True)
class LogBilinear:
    heads: int = 16_384
    class_size: int = 128
    spellings: int = 61
    size: int = 16
    noise: int = 25
    word_noise: int = 2
    batch: int = 16_384
    rate: float = 0.1
    seed: int = 13
    shard_tokens: int = 4_000_000
    folds: int = 7
    held_fold: int = 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def key_of(word: bytes) -> bytes:
    """The word itself, or a digest of a long one."""
    return word if len(word) <= LONG else b"\x00" + hashlib.sha256(word).digest()


def held_out(doc_id: int | None, spec: LogBilinear) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % spec.folds == spec.held_fold


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for b in batches:
        yield from zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())


def _counted(spec: LogBilinear):
    def batch(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in c], pa.binary()), pa.array(c.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for doc_id, text in _rows(batches):
            if not held_out(doc_id, spec):
                c.update(words(text))
                c[END] += 1
                if len(c) >= FLUSH:
                    yield batch(c)
                    c.clear()
        if c:
            yield batch(c)

    return run


def counts(docs: DataFrame, spec: LogBilinear) -> DataFrame:
    """Columns word (binary) and n over the training documents; the end of a text is the empty word."""
    return stored(docs.mapInArrow(_counted(spec), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def spelling(key: bytes, spec: LogBilinear) -> int:
    """The class of a word (as ``key_of`` gives it) that is no head."""
    return int.from_bytes(key[-2:], "big") % spec.spellings


def spelling_column(word: Column, spec: LogBilinear) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(word, -2, 2)), 16, 10).cast("int"), F.lit(spec.spellings))


@dataclass
class Vocabulary:
    """Heads by rank, classes, unigram counts. Ids: heads, then spellings, then the end (as a word before: the begin)."""

    ids: dict[bytes, int]  # known words by rank; the first are the heads
    counts: np.ndarray  # of known words
    spellings: np.ndarray  # of known words
    heads: int
    class_counts: np.ndarray  # heads' classes, spellings, end
    rest_norm: np.ndarray  # log10 of the smoothed total of each spelling
    spec: LogBilinear

    @classmethod
    def of(cls, known: list[tuple[bytes, int]], rest: dict[int, tuple[int, int]], ends: int, spec: LogBilinear) -> Vocabulary:
        """``rest``: tokens and words of each spelling among all words."""
        known = sorted(known, key=lambda r: (-r[1], r[0]))
        counts = np.array([n for _, n in known], np.float64)
        spellings = np.array([spelling(w, spec) for w, _ in known], np.int64)
        heads = min(spec.heads, len(known))
        n = np.array([rest.get(k, (0, 0)) for k in range(spec.spellings)], np.float64).reshape(-1, 2)
        np.subtract.at(n[:, 0], spellings[:heads], counts[:heads])
        np.subtract.at(n[:, 1], spellings[:heads], 1)
        by_class = np.bincount(np.arange(heads) // spec.class_size, counts[:heads], -(-heads // spec.class_size))
        return cls({w: k for k, (w, _) in enumerate(known)}, counts, spellings, heads, np.concatenate([by_class, n[:, 0] + 1, [ends + 1]]), np.log10(n.sum(1) + 1), spec)

    @property
    def end(self) -> int:
        return self.heads + self.spec.spellings

    @property
    def class_of(self) -> np.ndarray:
        """Of each id."""
        own = np.arange(self.heads) // self.spec.class_size
        return np.concatenate([own, len(self.class_counts) - 1 - self.spec.spellings + np.arange(self.spec.spellings + 1)])

    def numbers(self, words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its rank among known words (or -1) and its id."""
        rank = np.fromiter(map(self.ids.get, words_, repeat(-1)), np.int64, len(words_))
        ids = np.where(rank < self.heads, rank, self.heads + (self.spellings[rank] if len(self.spellings) else 0))
        unknown = np.flatnonzero(rank < 0)
        # of a word that is its own key, ``spelling`` said in place
        first, classes = self.heads, self.spec.spellings
        ids[unknown] = [first + (int.from_bytes(w[-2:], "big") % classes if len(w) <= LONG else spelling(key_of(w), self.spec)) for w in map(words_.__getitem__, unknown.tolist())]
        return rank, ids


class Parameters:
    """Vectors of words before, matrices of both places, vectors and biases of classes and of heads, as rows of one table."""

    def __init__(self, rows: np.ndarray, v: Vocabulary):
        self.rows, d = rows, v.spec.size
        cuts = np.cumsum([v.end + 1, 2 * d, len(v.class_counts), v.heads])
        self.q, c, u, w = rows[: cuts[0], :d], rows[cuts[0] : cuts[1], :d], rows[cuts[1] : cuts[2]], rows[cuts[2] : cuts[3]]
        self.c = c.reshape(2, d, d)
        self.classes, self.words = u, w  # with biases, which a further 1 in the predicted vector adds
        self.u, self.bu, self.w, self.bw = u[:, :d], u[:, d], w[:, :d], w[:, d]

    @classmethod
    def start(cls, v: Vocabulary) -> Parameters:
        r, d = np.random.default_rng(v.spec.seed), v.spec.size
        p = cls(np.zeros((v.end + 1 + 2 * d + len(v.class_counts) + v.heads, d + 1), np.float32), v)
        p.q[:] = r.normal(0, 0.1, p.q.shape)
        p.c[:] = np.stack([np.eye(d) * x for x in (0.5, 0.25)])
        p.u[:] = r.normal(0, 0.1, p.u.shape)
        p.bu[:] = np.log(v.class_counts / v.class_counts.sum())
        p.bw[:] = np.log(v.counts[: v.heads] / v.class_counts[v.class_of[: v.heads]])
        return p

    def logs(self, t: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Natural log probability of each (word, before, before that): of its class, and of a head within its class."""
        own, out = v.class_of[t[:, 0]], np.empty(len(t), np.float32)
        one, two = self.q @ self.c[0], self.q @ self.c[1]
        # the predicted vector, and the total over classes, are those of the two words before: once for each such pair
        pairs, of = np.unique(t[:, 1] * (v.end + 1) + t[:, 2], return_inverse=True)
        before, that = np.divmod(pairs, v.end + 1)
        h = np.ones((len(pairs), v.spec.size + 1), np.float32)
        h[:, :-1] = one[before]
        h[:, :-1] += two[that]
        # no product exceeds that of the lengths
        longest = [float(np.sqrt(np.einsum("nd,nd->n", x, x).max(initial=0))) for x in (h, self.classes, self.words)]
        plain, plain_words = (longest[0] * x < PLAIN for x in longest[1:])
        totals = np.empty(len(pairs), np.float32)
        for k in range(0, len(pairs), SCORED):
            totals[k : k + SCORED] = _log_totals(h[k : k + SCORED] @ self.classes.T, plain)
        for k in range(0, len(t), SCORED):
            at = of[k : k + SCORED]
            out[k : k + SCORED] = np.einsum("nd,nd->n", h[at], self.classes[own[k : k + SCORED]]) - totals[at]
        heads = np.flatnonzero(t[:, 0] < v.heads)
        heads = heads[np.argsort(own[heads].astype(np.uint16), kind="stable")]
        for of_class in np.split(heads, np.flatnonzero(np.diff(own[heads])) + 1) if len(heads) else ():
            first = int(own[of_class[0]]) * v.spec.class_size
            last = min(first + v.spec.class_size, v.heads)
            w = np.ascontiguousarray(self.words[first:last].T)
            for k in range(0, len(of_class), SCORED):
                at = of_class[k : k + SCORED]
                s = h[of[at]] @ w
                got = s[np.arange(len(s)), t[at, 0] - first]
                out[at] += got - _log_totals(s, plain_words)
        return out


def _log_totals(s: np.ndarray, plain: bool) -> np.ndarray:
    """Log of the sum of exponentials of each row; works in place. ``plain``: exponentials are in range as they are."""
    top = 0 if plain else s.max(1)
    if not plain:
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], s.dtype)) + top


def _scattered(at: np.ndarray, columns: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Sums by place of rows that are given as columns, in double precision."""
    return np.stack([np.bincount(at, c, size) for c in columns], 1).astype(np.float32)


class Trainer:
    """One shard's pass of noise-contrastive estimation; steps shrink by the gradients seen."""

    def __init__(self, v: Vocabulary, start: np.ndarray, shard: int):
        self.v, self.p = v, Parameters(start.copy(), v)
        self.random = np.random.default_rng([v.spec.seed, shard])
        self.squares = np.zeros_like(start)
        self.s = Parameters(self.squares, v)
        share = v.class_counts / v.class_counts.sum()
        self.class_share, self.class_noise = share, np.log(share * v.spec.noise).astype(np.float32)
        self.class_of, self.edges = v.class_of, np.concatenate([[0.0], np.cumsum(v.counts[: v.heads])])
        within = v.counts[: v.heads] / v.class_counts[self.class_of[: v.heads]]
        self.word_noise = np.log(within * v.spec.word_noise).astype(np.float32)
        self.seen = np.zeros(v.end + 1)
        self.before = np.zeros(v.end + 1)

    def weights(self) -> np.ndarray:
        """How often the shard saw what each row of the parameters stands for."""
        by_class = np.bincount(self.class_of, self.seen, len(self.v.class_counts))
        return np.concatenate([self.before, np.full(2 * self.v.spec.size, self.seen.sum()), by_class, self.seen[: self.v.heads]])

    def _step(self, value: np.ndarray, grad: np.ndarray, square: np.ndarray) -> None:
        by = grad * grad
        square += by
        np.sqrt(np.add(square, 1e-8, out=by), out=by)
        value += np.divide(self.v.spec.rate * grad, by, out=by)

    def take(self, texts: list[np.ndarray]) -> None:
        t = _contexts(texts, self.v.end)
        self.seen += np.bincount(t[:, 0], minlength=len(self.seen))
        self.before += np.bincount(t[:, 1], minlength=len(self.seen))
        # ids have two bytes, so three of them travel as one number
        t = (t[:, 0] | t[:, 1] << 16 | t[:, 2] << 32)[self.random.permutation(len(t))]
        for k in range(0, len(t), self.v.spec.batch):
            part = t[k : k + self.v.spec.batch]
            self._batch(part & 0xFFFF, part >> 16 & 0xFFFF, part >> 32)

    def _batch(self, x: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> None:
        v, p, s, spec = self.v, self.p, self.s, self.v.spec
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        n = np.float32(len(x))
        q1, q2 = p.q[x1], p.q[x2]
        h = q1 @ p.c[0] + q2 @ p.c[1]
        own = self.class_of[x]
        noise = self.random.choice(len(self.class_share), spec.noise, p=self.class_share)
        good = sigmoid(-((h * p.u[own]).sum(1) + p.bu[own] - self.class_noise[own]))
        bad = -sigmoid(h @ p.u[noise].T + p.bu[noise] - self.class_noise[noise])
        dh = good[:, None] * p.u[own] + bad @ p.u[noise]
        size = len(v.class_counts)
        ht = np.ascontiguousarray(h.T)
        gu = _scattered(own, good * ht, size) + _scattered(noise, ht @ bad, size)
        gb = np.bincount(own, good, size) + np.bincount(noise, bad.sum(0), size)
        at = np.flatnonzero(x < v.heads)
        if len(at):
            w, hw, c = x[at], h[at], own[at]
            low = self.edges[c * spec.class_size]
            high = self.edges[np.minimum((c + 1) * spec.class_size, v.heads)]
            draw = low[:, None] + self.random.random((len(at), spec.word_noise)) * (high - low)[:, None]
            others = np.minimum(np.searchsorted(self.edges, draw, "right") - 1, v.heads - 1)
            every = np.concatenate([w[:, None], others], 1)
            vectors = np.take(p.words, every, axis=0)
            vectors, biases = vectors[:, :, :-1], vectors[:, :, -1]
            z = np.einsum("nkd,nd->nk", vectors, hw) + biases - self.word_noise[every]
            g = -sigmoid(z)
            g[:, 0] += 1
            dh[at] += np.einsum("nk,nkd->nd", g, vectors)
            places = every.ravel()
            gw = _scattered(places, ((g * c[:, None]).ravel() for c in ht[:, at]), v.heads)
            gbw = np.bincount(places, g.ravel(), v.heads)
            self._step(p.w, gw / n, s.w)
            self._step(p.bw, (gbw / n).astype(np.float32), s.bw)
        dh /= n
        gq = _scattered(np.concatenate([x1, x2]), np.concatenate([p.c[0] @ dh.T, p.c[1] @ dh.T], 1), len(p.q))
        self._step(p.c, np.stack([q1.T @ dh, q2.T @ dh]), s.c)
        self._step(p.q, gq, s.q)
        self._step(p.u, gu / n, s.u)
        self._step(p.bu, (gb / n).astype(np.float32), s.bu)


def _contexts(rows: list[np.ndarray], begin: int) -> np.ndarray:
    """(word, before, before that) of texts, each with its end, which has the id of the begin."""
    flat = np.concatenate([x for r in rows for x in (np.array([begin, begin]), r)])
    three = np.stack([flat[2:], flat[1:-1], flat[:-2]], 1)
    keep = np.ones(len(flat), bool)
    first = np.cumsum([0, *(len(r) + 2 for r in rows[:-1])])
    keep[first] = keep[first + 1] = False
    return three[keep[2:]]


def digest_of(doc_id: int | None, text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(("" if doc_id is None else str(doc_id)).encode() + b"\x00" + (text or "").encode("utf-8", "replace"))


def _numbered(shards: int, model):
    """Shard, digest and ids (two bytes each) of each training document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = model.value
        out: list[tuple] = []
        for doc_id, text in _rows(batches):
            if not held_out(doc_id, v.spec):
                digest = digest_of(doc_id, text)
                ids = v.numbers(words(text))[1]
                out.append((int.from_bytes(digest[:8], "big") % shards, digest, np.concatenate([ids, [v.end]]).astype("<u2").tobytes()))
                if len(out) >= 1000:
                    yield _batch_of(out, (pa.int32(), pa.binary(), pa.binary()), ("shard", "digest", "ids"))
                    out = []
        if out:
            yield _batch_of(out, (pa.int32(), pa.binary(), pa.binary()), ("shard", "digest", "ids"))

    return run


def _batch_of(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


_SUMS = "chunk int, shard int, sums binary, weights binary"


def _trained(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = model.value
        trainer, key, held, size = None, None, [], 0

        def done() -> pa.RecordBatch:
            w = trainer.weights()
            sums = trainer.p.rows.astype(np.float64) * w[:, None]
            rows = [(k // CHUNK, key, sums[k : k + CHUNK].tobytes(), w[k : k + CHUNK].tobytes()) for k in range(0, len(w), CHUNK)]
            return _batch_of(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ("chunk", "shard", "sums", "weights"))

        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if shard != key:
                    if trainer is not None:
                        if held:
                            trainer.take(held)
                        yield done()
                    trainer, key, held, size = Trainer(v, start, shard), shard, [], 0
                held.append(np.frombuffer(raw, "<u2").astype(np.int64))
                size += len(held[-1])
                if size >= TAKEN:
                    trainer.take(held)
                    held, size = [], 0
        if trainer is not None:
            if held:
                trainer.take(held)
            yield done()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over shards, in the order of shards, of each chunk."""
    key, sums, weights = None, None, None

    def done() -> pa.RecordBatch:
        return _batch_of([(key, 0, sums.tobytes(), weights.tobytes())], (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ("chunk", "shard", "sums", "weights"))

    for b in batches:
        for chunk, a, w in zip(*(b.column(c).to_pylist() for c in ("chunk", "sums", "weights"))):
            a, w = np.frombuffer(a), np.frombuffer(w)
            if chunk == key:
                sums, weights = sums + a, weights + w
            else:
                if key is not None:
                    yield done()
                key, sums, weights = chunk, a, w
    if key is not None:
        yield done()


def fitted(docs: DataFrame, v: Vocabulary, tokens: int) -> Parameters:
    start = Parameters.start(v).rows
    model = docs.sparkSession.sparkContext.broadcast((v, start))
    shards = max(1, -(-tokens // v.spec.shard_tokens))
    rows = docs.mapInArrow(_numbered(shards, model), "shard int, digest binary, ids binary").groupBy("shard", "digest").agg(F.first("ids").alias("ids"))
    parts = rows.repartition(shards, "shard").sortWithinPartitions("shard", "digest").select("shard", "ids").mapInArrow(_trained(model), _SUMS)
    sums = stored(parts.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_summed, _SUMS), "parameters")
    out = start.astype(np.float64)
    for r in sums.collect():
        w = np.frombuffer(bytes(r["weights"]))
        at = np.arange(len(w)) + r["chunk"] * CHUNK
        mean = np.frombuffer(bytes(r["sums"])).reshape(len(w), -1) / np.maximum(w, 1e-9)[:, None]
        out[at[w > 0]] = mean[w > 0]
    return Parameters(out.astype(np.float32), v)


PARTS = "digest binary, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, model_log double, words array<binary>, times array<long>"


def _scored(model):
    """For each document a row of what is known in the task, and its further words, each with how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, rows, end_log, trained = model.value
        p = Parameters(rows, v)
        log = np.log10(v.counts + 1)
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
        names, types = zip(*((n, kinds[k]) for n, k in (x.split() for x in PARTS.split(", "))))

        def part(docs: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
            out, split = [], [words(text) for _, text in docs]
            sizes = np.array([len(w) for w in split])
            flat = [x for w in split for x in w]
            rank, ids = v.numbers(flat)
            ends = np.cumsum(sizes)
            found = np.where(rank >= 0, log[rank] if len(log) else 0.0, 0.0)
            rest = ids >= v.heads
            # of a word that is no head: its share of its class
            share = np.where(rest, found - v.rest_norm[np.where(rest, ids - v.heads, 0)], 0.0)
            texts = [np.concatenate([ids[e - n : e], [v.end]]) for n, e in zip(sizes.tolist(), ends.tolist())]
            logs = p.logs(_contexts(texts, v.end), v).astype(np.float64) / np.log(10) if trained else np.zeros(len(ids) + len(texts))
            totals = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]))
            for (doc_id, text), w, n, e, total in zip(docs, split, sizes.tolist(), ends.tolist(), totals.tolist()):
                own, r = slice(e - n, e), rank[e - n : e]
                digest = digest_of(doc_id, text)
                more = Counter(key_of(w[k]) for k in np.flatnonzero(r < 0).tolist())
                out.append((digest, doc_id, held_out(doc_id, v.spec), n + 1, int((r >= 0).sum()) + (end_log is not None), float(found[own].sum()) + (end_log or 0.0), total + float(share[own].sum()), list(more), list(more.values())))
            return _batch_of(out, types, names)

        for b in batches:
            held, size = [], 0
            for row in _rows([b]):
                held.append(row)
                size += len(row[1] or "")
                if size >= 2_000_000:
                    yield part(held)
                    held, size = [], 0
            if held:
                yield part(held)

    return run


def vocabulary(table: DataFrame, ends: int, spec: LogBilinear) -> Vocabulary:
    """From counts of all words; what reaches the driver is bounded: KNOWN words and the classes' sums."""
    some = table.where(F.octet_length("word") > 0)
    known = [(bytes(r["word"]), r["n"]) for r in most_frequent(some, "n", max(KNOWN, spec.heads)).collect()]
    sums = some.groupBy(spelling_column(F.col("word"), spec).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    return Vocabulary.of(known, {r["k"]: (r["n"], r["words"]) for r in sums}, ends, spec)


def scores(documents: DataFrame, spec: LogBilinear = LogBilinear()) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = counts(docs, spec)
    total, kinds = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = table.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v = vocabulary(table, ends, spec)
    p = fitted(docs, v, total) if total else Parameters.start(v)

    model = spark.sparkContext.broadcast((v, p.rows, float(np.log10(ends + 1)) if ends else None, bool(total)))
    parts = stored(docs.mapInArrow(_scored(model), PARTS), "parts")
    own = parts.drop("words", "times")
    rare = parts.select("digest", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word").join(table, "word")
    rare = rare.groupBy("digest").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    copies = own.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = own.join(rare, "digest", "left").join(copies, "digest", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.coalesce("copies", F.lit(1))
    base = F.col("known_log") + share("log") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + share("more").cast("long")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model_log") + share("log") if total else F.lit(0.0)).alias("score"),
    )
