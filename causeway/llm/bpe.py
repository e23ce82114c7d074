"""Byte-level BPE: a streaming transducer of bounded lookahead, and an incremental decoder.

Encoding. A sequence of tokens is what BPE makes of its bytes if and only if every two neighbours
are what BPE makes of theirs. So the last token of the encoding of a prefix is a token ``t`` that
ends there and fits what ends where ``t`` begins, and exactly one fits. The transducer keeps, for
every position of a window, that last token. The tokens of the window form a tree of
predecessors; a token is emitted once every position that later bytes can still build on (the
last ``lookahead`` ones) descends from it. ``lookahead`` comes from the merge list: no token is
longer than the longest token, so no later token can attach further back than that. The window
therefore stays within a few times this length, however long a text is, and what was emitted
never changes.

The text is cut into pieces by the byte-level pattern first, a stretch of it at a time. Pieces that recur come from a
table of bounded size; others pass through the transducer.

Decoding feeds the tokens' bytes to a state machine that holds at most three bytes of an unfinished
character, and replaces malformed sequences as the maximal-subpart rule says.

Defined results: null texts count as empty (no tokens, the digest of nothing). An empty table gives an empty
result. Repeated rows each give a row. Extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.runtime import serve, ship

#: The byte-level pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each of the two generations of the table of pieces, and of the table of fitting neighbours.
TABLE_SIZE, FITS_SIZE = 120_000, 300_000
#: Moves of the automaton over several falls that are kept.
MOVES_SIZE = 200_000
#: Bytes at the start of a piece whose walk is kept, and how many such walks.
START, STARTS_SIZE = 6, 60_000
#: Characters cut into pieces at a time.
STRETCH = 1 << 16


def located(name: str) -> str:
    """A path as it is; a bare file name in the folder of public tokenizers of the machine that reads it."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if printable, else the next of U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(located(path), encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        unwrap = lambda s: bytes(alphabet[c] for c in s)
        self.id_of = {unwrap(t): k for t, k in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {k: t for t, k in self.id_of.items()} | {k: s.encode() for s, k in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            left, right = self.id_of[unwrap(a)], self.id_of[unwrap(b)]
            whole = self.id_of[unwrap(a) + unwrap(b)]
            self.rank[left, right] = (k, whole)
            self.halves.setdefault(whole, (k, left, right))
        self.lookahead = max(map(len, self.id_of))
        self.size = [0] * (max(self.bytes_of) + 1)
        for t, k in self.id_of.items():
            self.size[k] = len(t)
        self._fits: dict[int, bool] = {}
        self._suffixes()
        self.moves = len(self.step) + MOVES_SIZE

    def _suffixes(self) -> None:
        """An automaton over bytes whose state tells the longest token that ends here; ``shorter`` leads on to the next."""
        self.proper = {k for t, k in self.id_of.items() if len(t) == 1 or self.merged(t) == [k]}
        step: dict[int, int] = {}
        up, byte, own, depth = [0], [0], [-1], [0]
        for t, k in self.id_of.items():
            if k not in self.proper:
                continue
            at = 0
            for c in t:
                nxt = step.get(at << 8 | c)
                if nxt is None:
                    nxt = step[at << 8 | c] = len(up)
                    up.append(at)
                    byte.append(c)
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = nxt
            own[at] = k
        fall, longest, self.shorter = [0] * len(up), [-1] * len(up), [-1] * len(self.size)
        self.step, self.fall, self.longest = step, fall, longest
        for at in sorted(range(1, len(up)), key=depth.__getitem__):
            fall[at] = self.move(fall[up[at]], byte[at]) if up[at] else 0
            longest[at] = own[at] if own[at] >= 0 else longest[fall[at]]
            if own[at] >= 0:
                self.shorter[own[at]] = longest[fall[at]]

    def move(self, at: int, c: int) -> int:
        step, fall = self.step, self.fall
        while (nxt := step.get(at << 8 | c)) is None:
            if not at:
                return 0
            at = fall[at]
        return nxt

    def moved(self, at: int, c: int) -> int:
        """As ``move``, which is kept as a step while there is room."""
        nxt = self.move(at, c)
        if len(self.step) < self.moves:
            self.step[at << 8 | c] = nxt
        return nxt

    def merged(self, raw: bytes) -> list[int]:
        """BPE of a short string by its definition: the leftmost pair of least rank merges first."""
        ids = [self.id_of[raw[k : k + 1]] for k in range(len(raw))]
        rank = self.rank
        while len(ids) > 1:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the bytes of ``a`` and then ``b`` as these two tokens.

        No pair across the boundary may merge before both sides are complete. Walks down the
        inner edges of both merge trees, from the last merges to the first.
        """
        known = self._fits.get(a << 32 | b)
        if known is None:
            if len(self._fits) >= FITS_SIZE:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        bound, alone = 1 << 40, (-1, 0, 0)
        while True:
            across = self.rank.get((a, b))
            if across is not None and across[0] < bound:
                return False
            (ra, _, right), (rb, left, _) = self.halves.get(a, alone), self.halves.get(b, alone)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, right
            else:  # of equal ranks, the left one merged first
                bound, b = rb + 1, left


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """Bytes of one piece in, tokens out as soon as they are stable."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.state = 0
        self.buf = bytearray()
        self.last: list[int] = []  # the last token of the encoding of buf[: k + 1]
        self.edge: int | None = None  # the token emitted last, of the same piece
        self.starts: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        v, last, state = self.v, self.last, self.state
        step, fall, longest, shorter, size, known, fits = v.step, v.fall, v.longest, v.shorter, v.size, v._fits.get, v.fits
        full = 4 * v.lookahead
        self.buf += raw
        end = len(last)
        for c in raw:
            while (nxt := step.get(state << 8 | c)) is None and state:
                state = fall[state]
            state = nxt or 0
            end += 1
            t = longest[state]
            while t >= 0:
                at = end - size[t] - 1
                if at >= 0:
                    before = last[at]
                elif at == -1:
                    if self.edge is None:
                        break
                    before = self.edge
                else:  # it would begin inside what was emitted
                    t = shorter[t]
                    continue
                good = known(before << 32 | t)
                if good or good is None and fits(before, t):
                    break
                t = shorter[t]
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            if end >= full:
                self.state = state
                out += self._stable(end)
                end = len(last)
        self.state = state
        return out

    def whole(self, raw: bytes) -> list[int]:
        """All tokens of a piece that fits into the window, so that nothing needs to be emitted before its end."""
        v = self.v
        if len(raw) >= 4 * v.lookahead:
            return self.feed(raw) + self.finish()
        head = raw[:START]
        held = self.starts.get(head)
        if held is None:
            last: list[int] = []
            state = self._walk(head, 0, last)
            if len(self.starts) >= STARTS_SIZE:
                self.starts.clear()
            self.starts[head] = state, tuple(last)
        else:
            state, last = held[0], [*held[1]]
        if len(raw) > START:
            self._walk(raw[START:], state, last)
        size, end = v.size, len(raw)
        out = []
        while end:
            out.append(t := last[end - 1])
            end -= size[t]
        out.reverse()
        return out

    def _walk(self, raw: bytes, state: int, last: list[int]) -> int:
        """Appends the last token of every further prefix of a piece; returns the automaton's state."""
        v, end = self.v, len(last)
        step, longest, shorter, size, known, fits, moved = v.step.get, v.longest, v.shorter, v.size, v._fits.get, v.fits, v.moved
        for c in raw:
            nxt = step(state << 8 | c)
            state = moved(state, c) if nxt is None else nxt
            t = longest[state]
            while (at := end - size[t]) >= 0:
                before = last[at]
                good = known(before << 32 | t)
                if good or good is None and fits(before, t):
                    break
                t = shorter[t]
            if t < 0:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            end += 1
        return state

    def _chain(self, at: int) -> list[int]:
        """Ends of the tokens that the encoding of buf[:at] consists of."""
        ends = []
        while at > 0:
            ends.append(at)
            at -= self.v.size[self.last[at - 1]]
        return ends[::-1]

    def _stable(self, size: int) -> list[int]:
        shared: set[int] | None = None
        for at in range(size - self.v.lookahead, size + 1):
            ends = set(self._chain(at))
            shared = ends if shared is None else shared & ends
        cut = max((e for e in shared or () if e < size - self.v.lookahead), default=0)
        if not cut:
            return []
        out = [self.last[e - 1] for e in self._chain(cut)]
        del self.buf[:cut], self.last[:cut]
        self.edge = out[-1]
        return out

    def finish(self) -> list[int]:
        out = [self.last[e - 1] for e in self._chain(len(self.buf))]
        self.buf.clear()
        self.last.clear()
        self.edge, self.state = None, 0
        return out


class Encoder:
    """Texts to tokens, with a table of recurring pieces."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.v.special, key=len, reverse=True)) + ")") if self.v.special else None
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.v.bytes_of) + 1)]
        self.transducer = Transducer(self.v)
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, s: str) -> bytes:
        """The ids of a piece, as little-endian unsigned 32-bit integers."""
        got = self.table.get(s)
        if got is None:
            got = self.older.get(s)
            if got is not None:
                return self._held(s, got)
            raw, t = s.encode("utf-8", "replace"), self.transducer
            whole = self.v.id_of.get(raw)
            ids = [whole] if whole is not None and whole in self.v.proper else t.whole(raw)
            got = b"".join(map(self.packed.__getitem__, ids))
            if len(s) <= 64:
                self._held(s, got)
        return got

    def _held(self, s: str, got: bytes) -> bytes:
        """Recent pieces stay: a full table becomes the older one, whose entries come back when met."""
        if len(self.table) >= TABLE_SIZE:
            self.older = dict(self.table)
            self.table.clear()
        self.table[s] = got
        return got

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All pieces in order, those of a stretch at a time: its last two may go on, or be cut otherwise, beyond its end."""
        at, size = 0, STRETCH
        while len(text) - at > size:
            found = self.find(text, at, at + size)
            if len(found) < 4:
                size *= 2
                continue
            del found[-2:]
            yield found
            at, size = at + sum(map(len, found)), STRETCH
        yield self.find(text, at) if at else self.find(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        table, piece = self.table, self.piece
        for found in self.pieces(text):
            yield b"".join([table.get(p) or piece(p) for p in found])

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids, in order. Strings of special tokens become those tokens."""
        if self.special is None or not any(s in text for s in self.v.special):
            yield from self._plain(text)
            return
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                yield np.array([self.v.special[part]], "<u4").tobytes()
            elif part:
                yield from self._plain(part)


class Decoder:
    """Tokens in, text out as soon as its characters are complete."""

    def __init__(self, path: str):
        self.bytes_of = vocabulary(path).bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for text in b.column("text"):
                text = text.as_py() or ""
                n, ids, back, dec, same = 0, hashlib.sha256(), hashlib.sha256(), Decoder(path), hashlib.sha256(text.encode("utf-8", "replace"))
                for block in enc.encode(text):
                    ids.update(block)
                    n += len(block) // 4
                    back.update(dec.feed(np.frombuffer(block, "<u4").tolist()).encode())
                back.update(dec.finish().encode())
                rows.append((n, ids.hexdigest(), back.hexdigest(), back.digest() == same.digest()))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return run


@cache
def _made(path: str) -> Encoder:
    return Encoder(path)


def _forget() -> None:
    _made.cache_clear()
    vocabulary.cache_clear()


def _encoder(path: str) -> Encoder:
    serve("bpe", _forget)
    return _made(path)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: number of tokens, digest of the ids, digest of the text decoded from them."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(path), SCHEMA)


def encoded(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, the ids as an array, their number and digest, and the digest of the text decoded from them."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                raw = [b"".join(enc.encode(t.as_py() or "")) for t in part.column("text")]
                ids = [np.frombuffer(x, "<u4") for x in raw]
                back = []
                for x in ids:
                    dec = Decoder(path)
                    back.append(hashlib.sha256((dec.feed(x.tolist()) + dec.finish()).encode()).hexdigest())
                sizes = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), lists, pa.array(np.diff(sizes), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(back)],
                    [key, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
