"""Token counts kept up to date by deltas: signed sums by source, language and tokenizer version.

A batch of changes (inserts, deletes, revisions) becomes a few signed sums, however many rows it has: a delete takes back what
an insert added, a revision takes back the old count and adds the new. Sums are formed before the
exchange, so that a source with a third of all rows is no larger a group than others. Committing writes the sums
to a folder of their own, then a small file with the batch's name that says which folder; this is moved into place, which
fails if the name is there. A name leads to one folder, whoever wrote last: a batch that is repeated, by a caller, by a retry after a
lost driver, or by two writers at once, counts once. ``compact`` sums what is committed into a generation, so that totals read one
generation and the batches after it.

Defined results: null sources, languages and texts are values of their own (a null text has no tokens). Groups whose sums all come to
zero are left out. An empty batch is committed and changes nothing. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.bpe import _encoder
from causeway.runtime import ship, stored

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
CHANGES = ("insert", "delete", "revise")


def count_tokens(text: str, tokenizer: str, path: str | None) -> int:
    """``words``: words between blanks; otherwise the byte-level vocabulary file at ``path``."""
    if not text:
        return 0
    if path is None:
        return len(text.encode("utf-8", "replace").split())
    return sum(map(len, _encoder(path).encode(text))) // 4


def counted(docs: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, n_chars: a row for each document and tokenizer version."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for name, path in tokenizers.items():
                n = pa.array([count_tokens(t, name, path) for t in texts], pa.int64())
                size = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([name] * b.num_rows, pa.string()), n, size], ["doc_id", "source", "lang", "tokenizer", "tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long, n_chars long")


def maintained(docs: DataFrame, gone: DataFrame, tokenizers: dict[str, str | None], ledger: Ledger) -> DataFrame:
    """Totals after three batches: documents are inserted with counts guessed from their length, revised to the counts of the
    tokenizers, and those whose id is in ``gone`` (doc_id) deleted. Every batch is sent twice, and the first ones are compacted."""
    rows = stored(counted(docs, tokenizers), "counted")
    guess, none = F.floor(F.col("n_chars") / 5), F.lit(None).cast("long")
    ids = gone.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    batches = {
        "load": rows.withColumns({"change": F.lit("insert"), "old_tokens": none, "tokens": guess}),
        "count": rows.withColumns({"change": F.lit("revise"), "old_tokens": guess}),
        "remove": rows.join(ids, "doc_id", "left_semi").withColumns({"change": F.lit("delete"), "old_tokens": none}),
    }
    for name, changes in batches.items():
        for _ in range(2):
            ledger.commit(name, changes)
        if name == "count":
            ledger.compact()
    return ledger.totals()


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch. ``changes``: the keys, change (insert, delete, revise), tokens, and old_tokens for revisions."""
    bad = ~F.coalesce(F.col("change").isin(*CHANGES), F.lit(False))
    kind = F.when(bad, F.raise_error(F.concat(F.lit("no such change: "), F.coalesce("change", F.lit("null"))))).otherwise(F.col("change"))
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    tokens = F.when(kind == "revise", F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Ledger:
    """Batches of signed sums in a folder of any file system that Spark reaches.

    ``sums``: folders of sums. ``batches``: for each batch a file that names its folder. ``generations``: for each number a file that names
    a folder of sums, then the batches that these hold.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._to = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._to(self.path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._to(self.path).toUri(), conf)
        for name in ("sums", "batches", "generations"):
            self._fs.mkdirs(self._to(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._to(f"{self.path}/{folder}")))
        return sorted(unquote(n) for n in found if not n.startswith("."))

    def batches(self) -> list[str]:
        return self._names("batches")

    def _place(self, folder: str, name: str) -> str:
        return f"{self.path}/{folder}/{quote(name, safe='')}"

    def _read(self, folder: str, name: str) -> list[str]:
        stream = self._fs.open(self._to(self._place(folder, name)))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
        finally:
            stream.close()

    def _claim(self, folder: str, name: str, lines: list[str]) -> bool:
        """Puts a file in place unless one of the name is there."""
        staged = f"{self.path}/sums/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._to(staged))
        stream.write("\n".join(lines).encode())
        stream.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._context.rename(self._to(staged), self._to(self._place(folder, name)), none)
            return True
        except Exception:
            if not self._fs.exists(self._to(self._place(folder, name))):
                raise
            self._fs.delete(self._to(staged), False)
            return False

    def _written(self, sums: DataFrame) -> str:
        folder = uuid.uuid4().hex
        sums.coalesce(1).write.parquet(f"{self.path}/sums/{folder}")
        return folder

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new. One that is there already is not even computed."""
        if self._fs.exists(self._to(self._place("batches", batch))):
            return False
        return self._claim("batches", batch, [self._written(signed(changes))])

    def _parts(self) -> tuple[int, list[str], list[str]]:
        """Number of the last generation, folders that make the totals, and batches that these hold."""
        last = max(map(int, self._names("generations")), default=0)
        first, *held = self._read("generations", str(last)) if last else [""]
        new = [b for b in self.batches() if b not in set(held)]
        return last, [*([first] if last else []), *(self._read("batches", b)[0] for b in new)], [*held, *new]

    def _summed(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/sums/{f}" for f in folders])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sums all that is committed into a new generation; false if another writer was faster, whose generation stands."""
        last, folders, held = self._parts()
        return self._claim("generations", str(last + 1), [self._written(self._summed(folders)), *held])

    def totals(self) -> DataFrame:
        return self._summed(self._parts()[1])
