"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

Two sets of shingles link if their intersection is at least ``num / den`` of their union. A set of n
shingles then shares at least T = ceil(n * num / den) with any partner. As in DivideSkip, its
inverted lists divide into the T - SHARED longest ones and the rest. The rest are merged: a query document gets, from each
of its short lists, the sorted ids of the list, and a heap merges them; an id that comes up SHARED times (or as often as the
pair can need, if that is less) is a candidate. The long lists are never read through: whether a candidate is in
them is found by binary search, of the one document's tokens in the other's sorted tokens, which also counts the whole intersection.

Which lists count as long must be the same for all documents. Tokens that a first pass, over one text in HOT_PART, finds in
many documents come last, the most frequent at the very end, all others go by their hash, so the choice costs part of a pass and no
global sort. A poor choice would cost time, not results: every document is looked up and compared, whatever was drawn.

Equal sets are one node. Between merging and probing, bit sketches of the sets drop pairs that
cannot overlap enough: the number of differing bits is a lower bound of the number of differing shingles. Of what is
left, each document is probed with one other first, then only pairs across the components that this gives.

A list of more than SHORT documents belongs to a group of like texts, whose pairs would grow as its square. It gives only links to
its smallest sets, a block of BLOCK entries at a time, and links among the blocks. What that connects
is one component. Lists that still hold several components are gone through twice: entries outside a list's
main component are compared, sketch against sketch, with all its blocks; first each document gives its closest partner only, then
every pair across components is given. So neither links nor failures within a large group become rows.
Tokens that the first pass finds in more than WIDE documents are salted, so that no task gets a whole list of them.

The plan is the same at every size: joins whose sides grow with the input are exchanged and merged. What is sent to all tasks is bounded: frequent
tokens (HOT_KEPT), and bits of hashed ids (BITS) by which rows that cannot be meant stay where they are; with more
ids than bits these let everything pass, and the join behind them decides.

Defined results: null, empty or blank texts have an empty set and link with nothing. Texts of fewer words than a
shingle have one shingle, all their words. Rows of one id are one node: it has the links of all its rows. A
null id has a null component and links with nothing. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.bounded import most_frequent
from causeway.llm.components import joined
from causeway.runtime import serve, ship, stored, unused_name

#: Occurrences in merged lists that a candidate needs; documents of a list that is merged; entries of a block of a longer list;
#: documents of a token above which its list is dealt over several tasks.
SHARED, SHORT, BLOCK, WIDE = 3, 64, 1024, 8192
#: A token is frequent if one in HOT_PART of the texts, drawn by their hash, stands for HOT_TOTAL sets with it; at most HOT_KEPT tokens
#: (16 bytes each) are sent to the tasks. All three only choose the order of tokens, and change no result.
HOT_PART, HOT_TOTAL, HOT_KEPT = 16, 48, 200_000
SHARD_BYTES = 4 << 20
#: Bits for hashed ids, sent to all tasks as at most BITS / 64 rows.
BITS = 1 << 25

_LOW, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Similarity:
    words: int = 4
    num: int = 85
    den: int = 100

    def least(self, n):
        """Shingles that a set of n shares with any partner, at least."""
        return -(-n * self.num // self.den)

    def needed(self, n, m):
        """Shingles that sets of n and m share if they link, at least."""
        return -(-(n + m) * self.num // (self.num + self.den))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = _mixed(total * _LOW + ids[k : k + n])
    return np.unique(total)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens over about twice as many bits as there are tokens."""
    bits = 64
    while bits < 2 * len(tokens) and bits < 1 << 15:
        bits *= 2
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: np.ndarray, size: int) -> np.ndarray:
    """Sketches (one a row) brought down to so many bytes."""
    while raw.shape[-1] > size:
        half = raw.shape[-1] // 2
        raw = raw[..., :half] ^ raw[..., half:]
    return raw


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    serve("ngram_join")
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= SHARD_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("ngram_join")
        for b in batches:
            tokens, counts = np.unique(np.concatenate([shingles(t, size) for t in b.column("text").to_pylist()] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, sim: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of many documents, sorted, into how many lists each is to be split, and its place by frequency."""
    drawn = docs.select("text", F.xxhash64("text").alias("hash")).where(F.pmod("hash", F.lit(HOT_PART)) == 0)
    # copies are one set, so they count once
    some = drawn.groupBy("hash").agg(F.first("text").alias("text")).select("text")
    sums = some.mapInArrow(_frequent(sim.words), "token long, n long").groupBy("token").agg((F.sum("n") * HOT_PART).alias("n")).where(F.col("n") >= HOT_TOTAL)
    rows = most_frequent(stored(sums, "frequent"), "n", HOT_KEPT).collect()
    tokens, n = (np.array([r[c] for r in rows], np.int64) for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    tokens, n = tokens[order].view(np.uint64), n[order]
    place = np.empty(len(n), np.int32)
    place[np.argsort(n, kind="stable")] = np.arange(len(n))
    return tokens, np.minimum(-(-n // WIDE), 1 << 15).astype(np.int32), place


SETS = "doc_id long, n int, sig binary, short binary, sketch binary"


def _described(sim: Similarity, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, _, by_count = hot.value
        for ids, texts in _shards(batches):
            cols: list[list] = [[], [], [], []]
            for t in texts:
                s = shingles(t, sim.words)
                n = len(s)
                cols[0].append(n)
                cols[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                if len(often) and n:
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    last = often[at] == s
                    order = np.concatenate([s[~last], s[last][np.argsort(by_count[at[last]])]])
                else:
                    order = s
                cols[2].append(order[: n - sim.least(n) + SHARED].tobytes())
                cols[3].append(sketch(s))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in SETS.split(", ")])

    return run


ENTRIES = "token long, salt int, n int, doc_id long, place int"


def _entries(hot):
    """A row for each entry of a merged list; entries of a token of very many documents are dealt over several lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, salts, _ = hot.value
        wide = salts > 1
        often, salts = often[wide], salts[wide]
        for b in batches:
            short = [np.frombuffer(x, np.uint64) for x in b.column("short").to_pylist()]
            sizes = np.array([len(x) for x in short], np.int64)
            if not sizes.sum():
                continue
            tokens = np.concatenate(short)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n, ids = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("n", "doc_id"))
            salt = np.zeros(len(tokens), np.int32)
            if len(often):
                at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                hit = often[at] == tokens
                # never 0: a list that is not whole is no short list
                salt[hit] = 1 + _mixed(ids[hit].view(np.uint64)) % salts[at[hit]].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(salt), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(place, pa.int32())], [x.split()[0] for x in ENTRIES.split(", ")])

    return run


#: Lists of queries: q and the ids of a short list. Blocks of long lists: token, block, ids, sizes. Links: a and b.
MERGED = "q long, n int, token long, block int, ids array<long>, sizes array<int>, a long, b long"


def _filled(**columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    size = len(next(iter(columns.values())))
    names = [x.split() for x in MERGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(size, kinds[k])) for c, k in names], [c for c, _ in names])


def _possible(n, m, i, j, sim: Similarity):
    """Whether sets of n and m with a common token in places i and j can share enough: by size, and by place."""
    fit = np.minimum(n, m) * sim.den >= np.maximum(n, m) * sim.num
    return fit & (np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1 >= sim.needed(n, m))


class _Lists:
    """Entries in the order of token, salt, size and id, read as lists. No more than a block of a long list is held."""

    def __init__(self, sim: Similarity) -> None:
        self.sim = sim
        self.rest = np.zeros((0, 5), np.int64)
        self.open: tuple[int, int] | None = None  # the long list that goes on
        self.centre: np.ndarray | None = None
        self.block = 0

    def feed(self, e: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([self.rest, e])
        if not len(e):
            return
        new = np.concatenate([[True], (e[1:, :2] != e[:-1, :2]).any(1)])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(e)]]))
        whole = np.ones(len(start), bool)
        if not last:
            whole[-1] = False
        going = np.array([tuple(e[k, :2]) == self.open for k in start[:1].tolist()] + [False] * (len(start) - 1))
        short = whole & ~going & (e[start, 1] == 0) & (size <= SHORT)
        yield from self.short(e, start[short], size[short])
        for k in np.flatnonzero(~short).tolist():
            rows = e[start[k] : start[k] + size[k]]
            if whole[k]:
                yield from self.long(rows, True)
                rows = rows[:0]
            else:
                while len(rows) >= max(BLOCK, SHORT + 1):
                    yield from self.long(rows[:BLOCK], False)
                    rows = rows[BLOCK:]
            self.rest = rows
        if whole[-1]:
            self.rest = e[:0]

    def short(self, e: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The list of each of its documents, of those that follow in the order of sizes and ids."""
        for length in np.unique(size[size >= 2]).tolist():
            at = start[size == length]
            x, y = np.triu_indices(length, 1)
            step = max(1, 500_000 // len(x))
            for k in range(0, len(at), step):
                i, j = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                p, q = e[i], e[j]
                good = np.flatnonzero((p[:, 3] != q[:, 3]) & _possible(p[:, 2], q[:, 2], p[:, 4], q[:, 4], self.sim))
                if not len(good):
                    continue
                i, j = i[good], j[good]
                order = np.lexsort((e[j, 3], i))
                i, j = i[order], j[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                ends = pa.array(np.concatenate([first, [len(i)]]), pa.int32())
                yield _filled(q=e[i[first], 3], n=e[i[first], 2], ids=pa.ListArray.from_arrays(ends, pa.array(e[j, 3])), sizes=pa.ListArray.from_arrays(ends, pa.array(e[j, 2], pa.int32())))

    def long(self, rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        """Blocks of a long list, and a link of each of its documents with the smallest set that can be like it."""
        key = tuple(rows[0, :2].tolist())
        if self.open != key:
            self.open, self.centre, self.block = key, rows[0], 0
        for k in range(0, len(rows), BLOCK):
            part, centres = rows[k : k + BLOCK], []
            for r in part[:, [2, 3]].tolist():
                if self.centre[2] * self.sim.den < r[0] * self.sim.num:
                    self.centre = part[len(centres)]
                centres.append(self.centre[3])
            a, b = np.array(centres), part[:, 3]
            far = a != b
            if far.any():
                yield _filled(a=np.minimum(a, b)[far], b=np.maximum(a, b)[far])
            one = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(v, kind))
            yield _filled(token=[key[0]], block=[key[1] << 15 | self.block], ids=one(b, pa.int64()), sizes=one(part[:, 2], pa.int32()))
            self.block += 1
        if last:
            self.open = None


def _merged(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(sim)
        for b in batches:
            yield from lists.feed(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1))
        yield from lists.feed(np.zeros((0, 5), np.int64), True)

    return run


def _pairs_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _heap_merged(sim: Similarity):
    """Short lists in the order of queries to candidates: ids that come up often enough in a query's lists."""

    def candidates(q: int, n: int, lists: list[list[int]], sizes: list[list[int]]) -> Iterator[tuple[int, int]]:
        least = min(SHARED, sim.needed(n, n))
        if len(lists) < least:
            return
        of: dict[int, int] = {}
        if n < 4 * SHARED:  # a pair may need less
            for ids, ms in zip(lists, sizes):
                for i, m in zip(ids, ms):
                    of[i] = min(m, of.get(i, m))
        for i, run in groupby(heapq.merge(*lists)):
            if sum(1 for _ in run) >= min(SHARED, sim.needed(n, of[i]) if of else SHARED):
                yield (q, i) if q < i else (i, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists, sizes, out = None, [], [], []
        for b in batches:
            for q, n, ids, ms in zip(*(c.to_pylist() for c in b.columns)):
                if (q, n) != key:
                    if key:
                        out += candidates(*key, lists, sizes)
                    key, lists, sizes = (q, n), [], []
                lists.append(ids)
                sizes.append(ms)
            if len(out) > 100_000:
                yield _pairs_batch(out)
                out = []
        if key:
            out += candidates(*key, lists, sizes)
        if out:
            yield _pairs_batch(out)

    return run


def _close(sim: Similarity):
    """Pairs whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = n + m - 2 * sim.needed(n, m)
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(u), len(v))
                keep[k] = int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) <= most[k]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingles(t, size).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "tokens"])

    return run


def _probed(sim: Similarity):
    """Links among pairs with their sorted sets: every token of the smaller set is looked up in the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta"), b.column("tb")):
                u, v = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                if not len(u):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep.append(sim.den * both >= sim.num * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input."""
    return left.join(right.hint("merge"), key, how)


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where the doc_id is not among ``ids``. Bits of hashed ids go to all tasks."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}) % 64 as int))")
    bits = stored(ids.select("doc_id").groupBy(F.shiftright(spot, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "bits")
    out = rows.withColumn("_word", F.shiftright(spot, 6)).join(F.broadcast(bits), "_word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _both(pairs: DataFrame, rows: DataFrame, **columns: str) -> DataFrame:
    """``pairs`` with columns of ``rows`` for each end, under the given name and the end's."""
    for end in "ab":
        pairs = _with(pairs, rows.select(F.col("doc_id").alias(end), *[F.col(c).alias(name + end) for c, name in columns.items()]), end)
    return pairs


def _exact(pairs: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs that link."""
    found = _marked(docs, _ends(pairs)).where("maybe").drop("maybe").mapInArrow(_sets_of(sim.words), "doc_id long, tokens binary")
    both = _both(pairs, stored(found, "tokens"), tokens="t")
    return stored(both.mapInArrow(_probed(sim), "a long, b long").distinct(), "links")


def _link(pairs: DataFrame, sets: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """Components (node, comp) that candidate pairs (a, b) give.

    Sketches go first. Of what they leave, each document is compared with one other; then only pairs across the
    components that this gives, so that a group of copies costs as many comparisons as it has members.
    """
    pairs = stored(pairs.distinct(), "pairs")
    sketches = _marked(sets.select("doc_id", "n", "sketch"), _ends(pairs)).where("maybe").drop("maybe")
    near = stored(_both(pairs, sketches, n="n", sketch="s").mapInArrow(_close(sim), "a long, b long").distinct(), "near")
    first = stored(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    comps = joined(docs.sparkSession.createDataFrame([], "node long, comp long"), _exact(first, docs, sim))
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    rest = near.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")
    rest = stored(rest, "rest")
    return comps if rest.isEmpty() else joined(comps, _exact(rest, docs, sim))


def _across(sim: Similarity, nearest: bool):
    """Pairs of different components between probes and a block of a list that sketches do not rule out.

    ``nearest``: of each document only the pair with the least share of differing bits.
    """

    def compare(rows: list[tuple]) -> set[tuple[int, int]]:
        """Rows: probe, id, size, component, sketch."""
        found: set[tuple[int, int]] = set()
        probe, ids, n, comp = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        wide = np.array([len(r[4]) for r in rows])
        best, mate = np.full(len(rows), np.inf), np.full(len(rows), -1)
        for width in np.unique(wide).tolist():
            # one side's sketches have this width, the other's at least as much
            for left, right in (((probe == 1) & (wide == width), (probe == 0) & (wide >= width)), ((probe == 1) & (wide > width), (probe == 0) & (wide == width))):
                x, y = np.flatnonzero(left), np.flatnonzero(right)
                if not len(x) or not len(y):
                    continue
                u, v = (np.stack([folded(np.frombuffer(rows[k][4], np.uint8), width) for k in z]).view(np.uint64) for z in (x, y))
                step = max(1, 200_000 // len(y))
                for k in range(0, len(x), step):
                    xs = x[k : k + step]
                    fit = comp[xs][:, None] != comp[y][None]
                    fit &= np.minimum(n[xs][:, None], n[y][None]) * sim.den >= np.maximum(n[xs][:, None], n[y][None]) * sim.num
                    r, c = np.nonzero(fit)
                    if not len(r):
                        continue
                    most = n[xs[r]] + n[y[c]] - 2 * sim.needed(n[xs[r]], n[y[c]])
                    diff = np.zeros(len(r), np.int64)
                    for w in range(u.shape[1]):
                        diff += np.bitwise_count(u[k + r, w] ^ v[c, w])
                    good = np.flatnonzero(diff <= most)
                    a, b = xs[r[good]], y[c[good]]
                    if not nearest:
                        found.update((min(p), max(p)) for p in zip(ids[a].tolist(), ids[b].tolist()))
                        continue
                    share = diff[good] / (n[a] + n[b])
                    order = np.argsort(share, kind="stable")
                    for own, other in ((a, b), (b, a)):
                        row, first = np.unique(own[order], return_index=True)
                        first = order[first]
                        better = share[first] < best[row]
                        best[row[better]], mate[row[better]] = share[first][better], other[first][better]
        at = np.flatnonzero(mate >= 0)
        found.update((min(p), max(p)) for p in zip(ids[at].tolist(), ids[mate[at]].tolist()))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, key = set(), [], None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("token", "block", "team", "probe", "doc_id", "n", "comp", "sketch")]
            for *own, probe, doc_id, n, comp, sk in zip(*cols):
                if own != key:
                    if rows:
                        found |= compare(rows)
                    rows, key = [], own
                rows.append((probe, doc_id, n, comp, sk))
            if len(found) > 100_000:
                yield _pairs_batch(list(found))
                found = set()
        if rows:
            found |= compare(rows)
        if found:
            yield _pairs_batch(list(found))

    return run


def _long_lists(blocks: DataFrame, comps: DataFrame, sets: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """``comps`` after the links across components that the blocks of long lists have.

    Of a list only the entries outside its largest component are probes; they meet every block, in teams of BLOCK at most on average.
    """
    entries = blocks.select("token", "block", F.explode(F.arrays_zip("ids", "sizes")).alias("x")).select("token", "block", F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n"))
    for nearest in (True, False):
        rows = stored(entries.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "entries")
        shares = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("share"))
        lists = shares.groupBy("token").agg(F.max(F.struct("share", "comp")).alias("main"), F.sum("share").alias("all"))
        open_ = lists.where("main.share < all").select("token", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.share")) / F.lit(BLOCK)).cast("int").alias("teams"))
        open_ = stored(open_, "open")
        if open_.isEmpty():
            return comps
        rows = stored(_with(rows, open_, "token"), "open_entries")
        probes = rows.where("comp <> main").withColumn("team", F.pmod(F.xxhash64("doc_id"), F.col("teams")).cast("int"))
        # a probe goes to every block of its list that has sets of a size to link with, an entry of a block to every team
        spans = rows.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        fit = (F.col("n") * F.lit(sim.den) >= F.col("low") * F.lit(sim.num)) & (F.col("high") * F.lit(sim.den) >= F.col("n") * F.lit(sim.num))
        named = probes.drop("block").withColumnRenamed("token", "of")
        probes = named.join(spans.hint("merge"), (F.col("of") == F.col("token")) & fit).withColumn("probe", F.lit(1))
        members = rows.withColumns({"team": F.explode(F.sequence(F.lit(0), F.col("teams") - 1)), "probe": F.lit(0)})
        meet = probes.select(*(cols := ("token", "block", "team", "probe", "doc_id", "n", "comp"))).union(members.select(*cols))
        sketches = _marked(sets.select("doc_id", "sketch"), rows.select("doc_id")).where("maybe").drop("maybe")
        meet = _with(meet, sketches, "doc_id").repartition("token", "block", "team").sortWithinPartitions("token", "block", "team")
        pairs = stored(meet.mapInArrow(_across(sim, nearest), "a long, b long").distinct(), "pairs")
        comps = joined(comps, _exact(pairs, docs, sim))
    return comps


def classes(documents: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = spark.sparkContext.broadcast(frequent_tokens(docs, sim))
    sets = stored(docs.mapInArrow(_described(sim, hot), SETS), "sets")

    small = sets.select("doc_id", "n", "sig")
    named = small.where("doc_id is not null and sig is not null")
    copies = stored(named.groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")).where("first <> other").select("sig", "first"), "copies")
    later = stored(_with(named, copies, "sig").where("doc_id <> first").select("doc_id", "sig", "first"), "later")

    sets = _marked(sets.where("doc_id is not null and n > 0"), later)
    checked = _with(sets.where("maybe"), later, ["doc_id", "sig"], "left_anti")
    nodes = sets.where("not maybe").unionByName(checked).select("doc_id", "n", "short", "sketch")
    entries = nodes.select("doc_id", "n", "short").mapInArrow(_entries(hot), ENTRIES)
    in_order = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id")
    merged = stored(in_order.mapInArrow(_merged(sim), MERGED), "merged")

    lists = merged.where("q is not null").select("q", "n", "ids", "sizes").repartition("q").sortWithinPartitions("q", "n")
    blocks = merged.where("token is not null").select("token", "block", "ids", "sizes")
    # the first entries of a list's blocks are linked with the smallest of them
    heads = blocks.select("token", F.col("ids")[0].alias("id"), F.col("sizes")[0].alias("size"))
    least = heads.groupBy("token").agg(F.min(F.struct("size", "id")).alias("least"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    bound = heads.join(least, "token").where("least.id <> id").select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b"))
    pairs = lists.mapInArrow(_heap_merged(sim), "a long, b long").union(merged.where("a is not null").select("a", "b")).union(bound)
    comps = _link(pairs, sets, docs, sim)
    if not blocks.isEmpty():
        comps = _long_lists(blocks, comps, sets, docs, sim)
    comps = joined(comps, later.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    known = small.where("doc_id is not null").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = known.select("doc_id", "n", F.coalesce("comp", "doc_id").alias("component_id"))
    out = out.union(small.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, sim: Similarity) -> DataFrame:
    """The rows of ``documents`` whose id is the smallest of its component; rows without id stay.

    Of rows of one id and one text a single one stays: the first as JSON. Rows of one id with different texts all stay.
    """
    got = classes(documents, sim)
    drop = stored(got.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    ids = stored(got.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    out = documents.join(drop, "doc_id", "left_anti")
    if ids.isEmpty():
        return out
    whole, json, kind = F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])), unused_name(out, "kind")
    one = out.join(ids, "doc_id", "left_semi").groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias(kind)).agg(F.min_by(whole, json).alias("row")).select("row.*")
    return out.join(ids, "doc_id", "left_anti").unionByName(one)
