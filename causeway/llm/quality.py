"""Quality rules: divergence of a document's histograms from references of its language.

Two histograms are taken of every whole text: of character classes, and of common words of the
four languages (one bin for every listed word, one for all others). A first pass sums both over
all documents of a language; these sums are the language's references. A second pass takes the
Jensen-Shannon distance (base 2, square root, within 0..1) of each document to the references of
its own language and rejects a document if either distance exceeds its threshold. The number of
words guards each distance: texts below ``min_words`` are too short for a histogram and pass.

Defined results: a null text counts as empty; it has no words, so it fails the base rule. A null or unlisted
language is compared with the references of all documents together. An empty table gives an empty
result. Repeated rows each give a row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.runtime import serve, ship

#: Common words by language (fixed values).
COMMON = {
    "en": "the of and to in a is that it for was on are as with be this from or by an at not which have",
    "de": "der die und das in den von zu ist mit sich des auf für im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au plus pas avec ce se il",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus",
}
LANGS = tuple(COMMON)
POOLED = "*"
WORDS = {w.encode(): k for k, w in enumerate(sorted({w for s in COMMON.values() for w in s.split()}))}
N_WORD_BINS = len(WORDS) + 1

#: Classes of bytes: 0 space, 1 lower, 2 upper, 3 digit, 4 stops, 5 bars and brackets, 6 exclamation, 7 other ASCII
#: signs, 8 first byte of a wider character.
CLASSES = 9
_CLASS_OF = np.full(256, -1, np.int64)
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"?-()", b"|<>[]{}", b"!")):
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[192:] = 8
_CLASS_OF[128:192] = CLASSES
_CLASS_OF[_CLASS_OF < 0] = 7

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: ASCII letters in lower case, bytes of wider characters kept, the rest blank.
_BARE = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(16)], np.uint64)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_pct: int = 30
    #: Fewest words, and largest distances, of the divergence verdict.
    guard_words: int = 20
    max_char_distance: float = 0.218
    max_word_distance: float = 0.42
    #: Short texts scatter: each limit grows by this over the square root of the number of words.
    scatter: float = 0.6


def histograms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    chars = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    get, other = WORDS.get, N_WORD_BINS - 1
    found = [get(w, other) for w in raw.translate(_BARE).split()]
    return chars, np.bincount(np.array(found, np.int64), minlength=N_WORD_BINS)


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 0 if one of them is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, kl / 2)))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that stand in a window of so many words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ids = ids ^ (ids >> np.uint64(29))
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += ids[k : k + n] * _ODD[k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_figures(text: str, raw: bytes, window: int) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, window),
    )


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def _sum_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serve("quality")
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), _texts(b)):
            both = np.concatenate(histograms(text.encode("utf-8", "replace")))
            for k in {lang if lang in LANGS else POOLED, POOLED}:
                sums[k] = sums[k] + both if k in sums else both
    for k, v in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [k] * len(v), "bin": pa.array(range(len(v)), pa.int32()), "n": pa.array(v, pa.int64())})


def references(docs: DataFrame) -> dict[str, np.ndarray]:
    """Histograms of all documents by language: five keys at most, of a fixed number of bins."""
    ship(docs.sparkSession)
    sums = docs.select("lang", "text").mapInArrow(_sum_histograms, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    out = {k: np.zeros(CLASSES + N_WORD_BINS, np.int64) for k in (*LANGS, POOLED)}
    for r in sums:
        out[r["lang"]][r["bin"]] = r["n"]
    return out


VERDICT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def _judge(text: str, lang: str | None, refs: dict[str, np.ndarray], rules: QualityRules) -> tuple:
    raw = text.encode("utf-8", "replace")
    base = base_figures(text, raw, rules.repeat_window)
    failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_pct * base[0]
    ref = refs[lang if lang in LANGS else POOLED]
    chars, words = histograms(raw)
    dc, dw = distance(chars, ref[:CLASSES]), distance(words, ref[CLASSES:])
    slack = rules.scatter / max(base[0], 1) ** 0.5
    diverges = base[0] >= rules.guard_words and (dc > rules.max_char_distance + slack / 4 or dw > rules.max_word_distance + slack)
    return *base, failed, dc, dw, not failed and not diverges


def _judged(refs: dict[str, np.ndarray], rules: QualityRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in VERDICT_SCHEMA.split(", ")]
        for b in batches:
            rows = [_judge(t, lang, refs, rules) for t, lang in zip(_texts(b), b.column("lang").to_pylist())]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return run


def verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each document: figures, distances, verdict."""
    refs = references(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_judged(refs, rules), VERDICT_SCHEMA)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; decided row by row, without a join."""
    refs = references(docs)
    at = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_judge(t, lang, refs, rules)[-1] for t, lang in zip(_texts(b), b.column("lang").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select(at)

    return docs.mapInArrow(run, docs.schema)
