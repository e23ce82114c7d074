import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from causeway.llm import bpe
from causeway.llm.bpe import located
from causeway.llm.entries import TOKENIZER

PATH = located(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    raw = b"".join(bpe.Encoder(PATH).encode(text))
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_same_as_the_library(library):
    r, enc = random.Random(1), bpe.Encoder(PATH)
    alphabet = ["a", "b", "th", "e", "ing", " ", "  ", "\n", "é", "ß", "中", "😀", "1", "23", "'s", "'ll", "!", "<|endoftext|>", "\t", "tion", " ", "　", "\r\n", "--", "===", "Z"]
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        raw = b"".join(enc.encode(t))
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == library.encode(t, add_special_tokens=False).ids, t
    for t in ("a" * 5000, "=-" * 4000, " " * 3000 + "x", "é" * 2000, "abtheing" * 700):
        assert ids_of(t) == library.encode(t, add_special_tokens=False).ids


def test_window_stays_bounded(library):
    v = bpe.vocabulary(PATH)
    t, out, most = bpe.Transducer(v), [], 0
    r = random.Random(3)
    text = "".join(r.choice("abtheing") for _ in range(20000)).encode()
    for k in range(0, len(text), 97):
        out += t.feed(text[k : k + 97])
        most = max(most, len(t.buf))
    out += t.finish()
    assert most <= 5 * v.lookahead
    assert out == library.encode(text.decode(), add_special_tokens=False).ids


def test_tables_turn_over(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 3)
    monkeypatch.setattr(bpe, "FITS_SIZE", 5)
    enc = bpe.Encoder(PATH)
    t = "xqzzj wvvkq xqzzj plmokn " * 20
    raw = b"".join(enc.encode(t))
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == library.encode(t, add_special_tokens=False).ids


def test_decoder_in_pieces():
    d, v = bpe.Decoder(PATH), bpe.vocabulary(PATH)
    ids = [v.id_of[bytes([b])] for b in "é😀".encode()]
    assert "".join(d.feed([k]) for k in ids) + d.finish() == "é😀"
    assert d.feed([v.id_of[b"\xe2"]]) + d.finish() == "�"


def test_query(spark, library):
    texts = [None, "", "plain words here", "é😀 <|endoftext|> x", "same", "same"]
    df = spark.createDataFrame([(k % 5, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(bpe.token_digests(df, PATH).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    want = []
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k % 5, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert [tuple(r)[:4] for r in got] == sorted(want, key=lambda r: (r[0], r[1]))
    assert all(r["round_trip"] for r in got)
    assert bpe.token_digests(df.limit(0), PATH).count() == 0
    whole = bpe.encoded(df.where("text is not null"), PATH).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in whole)


def test_pieces_of_stretches(monkeypatch):
    import random

    r = random.Random(3)
    enc = bpe.Encoder(PATH)
    texts = ["".join(r.choice(["a", "é", " ", "  ", "\n", "'", "'s", "'ll", "9", "!", "\t", "word", "\u3000", "’"]) for _ in range(r.randrange(300))) for _ in range(300)]
    texts += ["x" * 500 + " y", " " * 400 + "z", "a " * 200]
    for size in (5, 8, 64):
        monkeypatch.setattr(bpe, "STRETCH", size)
        for t in texts:
            assert [p for some in enc.pieces(t) for p in some] == enc.find(t)


def test_long_and_short_pieces_walk_alike(library, monkeypatch):
    monkeypatch.setattr(bpe, "STARTS_SIZE", 7)
    monkeypatch.setattr(bpe, "MOVES_SIZE", 5)
    v, r = bpe.Vocabulary(PATH), random.Random(9)
    fast, slow = bpe.Transducer(v), bpe.Transducer(v)
    for n in [*range(1, 40), 4 * v.lookahead - 1, 4 * v.lookahead, 4 * v.lookahead + 1] * 6:
        raw = "".join(r.choice(["th", "e", "tion", "an", "é", "x", "中"]) for _ in range(n)).encode()[:n]
        assert fast.whole(raw) == slow.feed(raw) + slow.finish()
    assert len(fast.starts) <= 7 and len(v.step) <= v.moves


def test_walks_are_taken_from_known_starts():
    t, seen = bpe.Transducer(bpe.vocabulary(PATH)), []
    walk = t._walk
    t._walk = lambda raw, state, last: (seen.append(len(raw)), walk(raw, state, last))[1]
    for end in (b"anly", b"reor", b"inth"):
        t.whole(b" reoning"[: bpe.START] + end)
    assert seen == [bpe.START, 4, 4, 4]
