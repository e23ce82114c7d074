"""Benchmark decontamination with suffix arrays of the training texts.

Every task cuts its documents into shards of bounded size and builds a suffix array of each
shard's words. Words that no benchmark item has can be part of no match; they separate runs, and
runs shorter than the shortest window are left out of the array, which loses no match. Every
suffix of every test item is looked up by binary search; all suffixes of the array that share its
first ``window`` words (all its words, where the item has fewer) are places where it matches. From the places that go
no further to the left, matches are followed word by word to their end: these are the longest verbatim matches, each with
item, place in the item, place in the document and length. They do not depend on how documents fall into shards.
No row is exchanged between tasks.

The benchmark travels to the tasks in blocks of about ``BLOCK_BYTES`` of text, as words and one array of word numbers;
what the tasks build of a block is a dictionary of its words. At most ``BLOCKS_A_PASS`` blocks are in one pass over
the documents, and the driver holds one at a time, so that the benchmark's size is no bound on memory. An item is
never cut: one larger than a block is a block of its own.

Defined results: a null text has no words. Items without words have no window; an item of fewer words than a
window is one window. Items with a null id hit words but are not listed. An id that several items share is listed
once. Repeated document rows each give a row. An empty benchmark leaves all documents clean. Extra columns are kept
by ``decontaminate``, whatever their names, and otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.runtime import serve, ship, stored, unused_name

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES, BLOCKS_A_PASS = 4 << 20, 8
#: Places compared at a time.
STEP = 500_000

#: Digits, letters in lower case and bytes of wider characters stay; the rest is blank.
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class Block:
    """A part of the benchmark: its distinct words, and the numbers of all items' words, each item ended by -9."""

    words: list[bytes]
    flat: np.ndarray
    items: list[str | None]
    begins: np.ndarray  # of items in ``flat``, and the end
    window: int = WINDOW

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
        ids: dict[bytes, int] = {}
        parts, names, begins = [], [], [0]
        for item, text in items:
            ws = [ids.setdefault(w, len(ids)) for w in words(text)]
            if ws:
                parts.append(np.array([*ws, -9], np.int32))
                names.append(item)
                begins.append(begins[-1] + len(ws) + 1)
        return cls(list(ids), np.concatenate(parts) if parts else np.zeros(0, np.int32), names, np.array(begins, np.int64), window)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Begins of test suffixes that have a window, and the sizes of their windows."""
        sizes = np.diff(self.begins) - 1
        least = np.minimum(sizes, self.window)
        n = sizes - least + 1
        at = np.repeat(self.begins[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, np.repeat(least, n)


class Lookup:
    """A block as a task uses it."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.word_ids = {w: k for k, w in enumerate(block.words)}
        self.flat = np.concatenate([block.flat.astype(np.int64), np.full(block.window, -9)])
        self.at, self.sizes = block.suffixes()


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words; -1 ends a suffix. By prefix doubling."""
    n, k = len(s), 1
    rank = (s + 1).astype(np.int64)
    ends = int((s < 0).sum())
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:]
        key = np.where(rank > 0, rank * (int(rank.max()) + 1) + after, 0)
        kinds, rank = np.unique(key, return_inverse=True)
        if len(kinds) >= n - ends + (ends > 0):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def _signs(s: np.ndarray, places: np.ndarray, test: Lookup, which: np.ndarray) -> np.ndarray:
    """Sign of each place's suffix against a test suffix, as far as the window goes."""
    reach = np.arange(test.block.window)
    diff = np.sign(s[places[:, None] + reach] - test.flat[test.at[which][:, None] + reach])
    diff[reach >= test.sizes[which][:, None]] = 0
    return diff[np.arange(len(places)), (diff != 0).argmax(axis=1)]


def search(s: np.ndarray, sa: np.ndarray, test: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of the suffix array that begins with its window."""
    padded = np.concatenate([s, np.full(test.block.window, -1, s.dtype)])
    lows, highs = [], []
    for k in range(0, len(test.at), STEP):
        which = np.arange(k, min(k + STEP, len(test.at)))
        for upper, out in ((False, lows), (True, highs)):
            lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                sign = _signs(padded, sa[mid], test, which[open_])
                right = (sign <= 0) if upper else (sign < 0)
                lo[open_[right]] = mid[right] + 1
                hi[open_[~right]] = mid[~right]
            out.append(lo)
    return np.concatenate(lows), np.concatenate(highs)


def longest_matches(s: np.ndarray, test: Lookup) -> np.ndarray:
    """Rows (begin in ``s``, begin in the test words, length) of all matches that go no further on either side."""
    sa = suffix_array(s, test.block.window)
    lo, hi = search(s, sa, test)
    s = np.concatenate([s, [-1]])
    out = [np.zeros((0, 3), np.int64)]
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    ends = np.cumsum(counts)
    for a in range(0, int(counts.sum()), STEP):
        n = np.arange(a, min(a + STEP, int(ends[-1])))
        k = np.searchsorted(ends, n, "right")
        place = sa[lo[found[k]] + n - (ends[k] - counts[k])]
        at = test.at[found[k]]
        # a match with the same word in front of it on both sides is part of another
        left = (place > 0) & (at > 0) & (s[place - 1] == test.flat[at - 1])
        place, at, size = place[~left], at[~left], test.sizes[found[k[~left]]].copy()
        going = np.arange(len(place))
        while len(going):
            going = going[s[np.minimum(place[going] + size[going], len(s) - 1)] == test.flat[at[going] + size[going]]]
            size[going] += 1
        out.append(np.stack([place, at, size], 1))
    return np.concatenate(out)


@dataclass
class Found:
    """What a text has: words, merged hit spans of words, matches (item, begin in the item, begin, length)."""

    words: int
    spans: list[tuple[int, int]]
    matches: list[tuple[str | None, int, int, int]]


def scan(texts: list[str | None], test: Lookup) -> list[Found]:
    get = test.word_ids.get
    parts, counts = [], []
    for t in texts:
        ws = words(t)
        counts.append(len(ws))
        parts += [np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws)), np.array([-1])]
    out = [Found(n, [], []) for n in counts]
    if not len(test.at) or not parts:
        return out
    s = np.concatenate(parts)
    n = len(s)
    at = np.arange(n)
    stop = np.minimum.accumulate(np.where(s < 0, at, n)[::-1])[::-1]
    begun = np.maximum.accumulate(np.where(s < 0, at, -1))
    keep = (s >= 0) & (stop - begun - 1 >= test.sizes.min())
    keep |= np.concatenate([[False], keep[:-1]]) & (s < 0)  # one end behind each run
    place = np.flatnonzero(keep)
    if not len(place):
        return out
    got = longest_matches(s[place], test)
    if not len(got):
        return out
    begin = place[got[:, 0]]
    first = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    doc = np.searchsorted(first, begin, "right") - 1
    item = np.searchsorted(test.block.begins, got[:, 1], "right") - 1
    rows = np.stack([doc, begin - first[doc], item, got[:, 1] - test.block.begins[item], got[:, 2]], 1)
    for d, b, i, offset, size in rows[np.lexsort(rows.T[::-1])].tolist():
        out[d].matches.append((test.block.items[i], offset, b, size))
    for d in np.unique(doc).tolist():
        out[d].spans = merged([(b, b + size) for _, _, b, size in out[d].matches])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """Blocks one after the other, at least one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where(F.col("text").isNotNull())
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK_BYTES))
    for k in range(n):
        yield Block.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()], window)


FOUND = "struct<words:bigint,spans:array<int>,matches:array<struct<item:string,item_begin:int,begin:int,words:int>>>"


def _passes(block, names: list[str], own: str):
    """Adds what a block hits to the column ``own``."""

    def cut(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        texts = b.column("text").to_pylist()
        start, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= SHARD_BYTES or k == len(texts) - 1:
                yield b.slice(start, k + 1 - start), texts[start : k + 1]
                start, size = k + 1, 0

    def part(b: pa.RecordBatch, texts: list, test: Lookup) -> pa.RecordBatch:
        rows = []
        for old, new in zip(b.column(own).to_pylist(), scan(texts, test)):
            spans = merged([*zip(old["spans"][::2], old["spans"][1::2]), *new.spans])
            matches = [*old["matches"], *({"item": i, "item_begin": o, "begin": a, "words": n} for i, o, a, n in new.matches)]
            rows.append({"words": new.words, "spans": [v for ab in spans for v in ab], "matches": matches})
        return pa.RecordBatch.from_arrays([pa.array(rows, b.schema.field(own).type) if c == own else b.column(c) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("decontam")
        test = Lookup(block.value)
        for b in batches:
            for piece, texts in cut(b):
                yield part(piece, texts, test)

    return run


def annotated(docs: DataFrame, benchmark: DataFrame, own: str, window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct ``own``: number of words, hit spans of words (flat list of begins and ends), matches."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.withColumn(own, F.from_json(F.lit('{"words":0,"spans":[],"matches":[]}'), FOUND))
    schema = out.schema
    for k, block in enumerate(_blocks(benchmark, window)):
        if k and k % BLOCKS_A_PASS == 0:
            out = stored(out, "annotated")
        out = out.mapInArrow(_passes(spark.sparkContext.broadcast(block), schema.names, own), schema)
    return out


def _hit(own: str) -> Column:
    """Words in hit spans."""
    spans = F.col(f"{own}.spans")
    sizes = F.transform(spans, lambda v, k: F.when(k % 2 == 1, v - F.get(spans, k - 1)).otherwise(0))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, v: acc + v)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: words, hit words, items, digest of the items, verdict, words of the longest match.

    The verdict asks for a twentieth of the document's words at least.
    """
    own = "found"
    items = F.array_sort(F.array_distinct(F.filter(F.transform(f"{own}.matches", lambda x: x["item"]), lambda x: x.isNotNull())))
    rows = annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, own, window)
    rows = rows.select("doc_id", F.col(f"{own}.words").alias("n_words"), _hit(own).alias("n_hit"), items.alias("items"), F.col(f"{own}.matches").alias("matches"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["words"])), F.lit(0)).alias("longest_match"),
        "matches",
    )


def locations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each longest match: doc_id, item, item_begin, begin (places of words from 0), words."""
    return contamination(docs, benchmark, window).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` without a match, or with less than ``least_share`` of their words in matches; their own columns."""
    own = unused_name(docs, "found")
    hit = _hit(own)
    rows = annotated(docs, benchmark, own, window)
    return rows.where((hit == 0) | (hit < F.lit(least_share) * F.col(f"{own}.words"))).select(*[F.col(f"`{c}`") for c in docs.columns])
