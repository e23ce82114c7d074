"""Source distributions as rows: archives and directories are read as data, checked first, never unpacked to disk.

An archive is one task's work, bounded by the limits; a fault of its author becomes a row that tells why it was skipped, so that it
costs no other. Only Python files and pyproject.toml keep their bytes.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions import names, paths
from causeway.runtime import ship


@dataclass(frozen=True)
class Limits:
    entries: int = 20_000
    total_bytes: int = 256 << 20
    file_bytes: int = 16 << 20
    metadata_bytes: int = 1 << 20


class Refused(Exception):
    """What is wrong with an archive: reason and detail."""

    def __init__(self, reason: str, detail: str):
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail = reason, detail


def classify(path: str) -> str | None:
    """IO-01."""
    return "setup_py" if path == "setup.py" else "pyproject_toml" if path == "pyproject.toml" else "python" if path.endswith(".py") else None


def parts_of(path: str) -> list[str]:
    return [p for p in re.split(r"[/\\]", path) if p not in ("", ".")]


def check_entry(path: str, kind: str) -> None:
    """IO-06."""
    if re.match(r"[/\\]|[A-Za-z]:", path):
        raise Refused("extraction_failed", f"absolute path {path!r}")
    parts = parts_of(path)
    if ".." in parts or not parts and kind != "directory":
        raise Refused("extraction_failed", f"path traversal {path!r}")
    if kind not in ("file", "directory"):
        raise Refused("extraction_failed", f"{kind} {path!r}")


def entry_kind(member: tarfile.TarInfo) -> str:
    """IO-08. Extended headers and long names never get here: the reader applies them to what follows."""
    return "directory" if member.isdir() else "symlink" if member.issym() else "hardlink" if member.islnk() else "file" if member.isreg() else "special entry"


def members(data: bytes, limits: Limits) -> Iterator[tuple[str, str, int, bytes | None]]:
    """IO-09: path, kind, size and reader of every member in one pass; limits hold for the bytes produced."""
    bounded = _Bounded(data, limits.total_bytes + (limits.entries + 64) * 1536)
    total = n = 0
    try:
        with tarfile.open(fileobj=bounded, mode="r|") as tar:
            for m in tar:
                n += 1
                kind = entry_kind(m)
                check_entry(m.name, kind)
                if n > limits.entries:
                    raise Refused("extraction_failed", f"more than {limits.entries} entries")
                if m.size > limits.file_bytes:
                    raise Refused("extraction_failed", f"{m.name!r} is larger than {limits.file_bytes} bytes")
                total += m.size
                if total > limits.total_bytes:
                    raise Refused("extraction_failed", f"more than {limits.total_bytes} bytes")
                wanted = kind == "file" and (m.name.endswith((".py", "pyproject.toml")) or m.name.endswith("PKG-INFO") and m.size <= limits.metadata_bytes)
                yield m.name, kind, m.size, tar.extractfile(m).read() if wanted else None
    except (tarfile.TarError, zlib.error, EOFError, OSError, ValueError) as e:
        raise Refused("extraction_failed", f"unreadable archive: {type(e).__name__}") from e


class _Bounded(io.RawIOBase):
    """A gzip stream that fails once more bytes came out of it than allowed."""

    def __init__(self, data: bytes, most: int):
        self.data, self.at, self.most, self.made = data, 0, most, 0
        self.inflate, self.held = zlib.decompressobj(47), b""

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        while len(self.held) < size and (self.at < len(self.data) or self.inflate.unconsumed_tail):
            chunk = self.inflate.unconsumed_tail or self.data[self.at : self.at + 65536]
            if not self.inflate.unconsumed_tail:
                self.at += len(chunk)
            out = self.inflate.decompress(chunk, max(size, 65536))
            self.made += len(out)
            if self.made > self.most:
                raise Refused("extraction_failed", f"more than {self.most} bytes come out")
            self.held += out
            if self.inflate.eof:
                break
        out, self.held = self.held[:size], self.held[size:]
        return out


def core_metadata(text: str) -> dict:
    """IO-16: name, version and requirements from the lines before the first blank one."""
    out: dict = {"name": None, "version": None, "requires_dist": []}
    for line in text.splitlines():
        if not line.strip():
            break
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if colon and key in ("name", "version"):
            out[key] = value
        elif colon and key == "requires-dist" and value:
            out["requires_dist"].append(value)
    return out


def _uncommented(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if not quote and c == "#":
            return line[:k]
        quote = (c if c in "\"'" else "") if not quote else "" if c == quote else quote
    return line


def pyproject(text: str) -> tuple[str | None, list[str]]:
    """IO-17: build backend and its path, line by line. A backend that is no quoted string counts as none."""
    backend, where, inside, open_ = None, [], False, None
    quoted = lambda s: [a or b for a, b in re.findall(r""""([^"]*)"|'([^']*)'""", s)]
    for raw in text.splitlines():
        line = _uncommented(raw).strip()
        if not line:
            continue
        if open_ is not None:
            open_ += " " + line
            if "]" in line:
                where, open_ = quoted(open_), None
            continue
        if line.startswith("["):
            inside = line.strip("[]").strip() == "build-system"
            continue
        key, equals, value = line.partition("=")
        if not inside or not equals:
            continue
        if key.strip() == "build-backend":
            m = re.fullmatch(r"""(["'])(.*)\1""", value.strip())
            if m is None:
                return None, []
            backend = m[2]
        elif key.strip() == "backend-path":
            if "]" in value:
                where = quoted(value)
            else:
                open_ = value
    return backend, where


FILE = "struct<path:string,kind:string,size_bytes:bigint,text:string>"
DIST = f"""dist_id string, filename string, kind string, sha256 string, size_bytes long, name string, version string,
reason string, detail string, files array<{FILE}>, build_backend string, backend_path array<string>, requires_dist array<string>, has_pkg_info boolean"""


def read_sdist(filename: str, data: bytes, limits: Limits = Limits()) -> dict:
    """IO-03, IO-04, IO-09..IO-11, IO-14, IO-16, IO-20: one row for one file."""
    m = re.fullmatch(r"(.+)-([^-]+)\.tar\.gz", filename)
    out = {"dist_id": filename, "filename": filename, "kind": "sdist" if m else "wheel" if filename.endswith(".whl") else "other", "sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data), "name": m and m[1], "version": m and m[2], "files": [], "requires_dist": [], "backend_path": []}
    if not filename.endswith(".tar.gz"):
        return out | {"reason": "not_an_sdist", "detail": filename}
    try:
        found = [(parts_of(p), k, n, b) for p, k, n, b in members(data, limits)]
        tops = {p[0] for p, *_ in found if p}
        if len(tops) != 1 or any(len(p) == 1 and k == "file" for p, k, *_ in found):
            raise Refused("extraction_failed", "not one top-level directory")
    except Refused as e:
        return out | {"reason": e.reason, "detail": e.detail}
    files: dict[str, dict] = {}
    for p, kind, size, body in found:
        path = "/".join(p[1:])
        if kind != "file":
            continue
        if path == "PKG-INFO":
            if body is not None:
                meta = core_metadata(body.decode("utf-8", "replace"))
                out |= {"requires_dist": meta["requires_dist"], "has_pkg_info": True}
                out["name"], out["version"] = meta["name"] or out["name"], meta["version"] or out["version"]
        own = classify(path)
        text = body.decode("utf-8", "replace") if own and body is not None else None  # IO-02
        files.setdefault(path, {"path": path, "kind": own, "size_bytes": size, "text": text})
    out["files"] = [files[k] for k in sorted(files)]  # IO-13
    top = files.get("pyproject.toml")
    if top is not None and top["text"] is not None:
        out["build_backend"], out["backend_path"] = pyproject(top["text"])
    return out


def listed(spark: SparkSession, directory: str | list[str]) -> DataFrame:
    """IO-22: path and content of the files directly in a directory (or of the files named)."""
    return spark.read.format("binaryFile").load(directory).select("path", "content")


def unpacked(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """IO-11: a row for each file (path, content)."""
    ship(files.sparkSession)
    schema = T._parse_datatype_string(DIST)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                yield pa.RecordBatch.from_pylist([read_sdist(path.rsplit("/", 1)[-1], data.as_py(), limits)], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def sdists(spark: SparkSession, directory: str | list[str], limits: Limits = Limits()) -> DataFrame:
    return unpacked(listed(spark, directory), limits)


def directory(spark: SparkSession, path: str, dist_id: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """IO-12: the sources of one directory in place: dist_id, path, kind, size_bytes, text. Links are not followed; no identity.

    Spark's own listing hides names that begin with an underscore, as ``__init__.py`` does, so the driver lists and reads;
    the limits bound what it may hold. Exceeding them is an error.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toUri().getPath() + "/"
    todo, rows, total = [root], [], 0
    while todo:
        for s in fs.listStatus(todo.pop()):
            rel = s.getPath().toUri().getPath().removeprefix(base)
            if s.isSymlink() or _is_link(s.getPath()):
                continue
            if s.isDirectory():
                todo.append(s.getPath())
                continue
            kind, size, text = classify(rel), s.getLen(), None
            total += size
            if size > limits.file_bytes or total > limits.total_bytes or len(rows) >= limits.entries:
                raise ValueError(f"beyond the limits of a scan: {rel}")
            if kind is not None:
                stream = fs.open(s.getPath())
                text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
                stream.close()
            rows.append((dist_id or path, rel, kind, size, text))
    return spark.createDataFrame(sorted(rows), "dist_id string, path string, kind string, size_bytes long, text string")


def _is_link(path) -> bool:
    """Local file systems report what a link points to."""
    uri = path.toUri()
    return uri.getScheme() in (None, "file") and os.path.islink(uri.getPath())


def sources_of(dists: DataFrame) -> DataFrame:
    """dist_id, path, text of what can be analysed."""
    return dists.where("reason is null").select("dist_id", F.explode("files").alias("f")).where("f.text is not null").select("dist_id", "f.path", "f.text")


def python_of(dists: DataFrame) -> DataFrame:
    """One row for each distribution that can be analysed, with all its Python files; nothing is exchanged."""
    python = F.filter("files", lambda f: f["text"].isNotNull() & F.endswith(f["path"], F.lit(".py")))
    files = F.transform(python, lambda f: F.struct(f["path"].alias("path"), f["text"].alias("text")))
    return dists.where("reason is null").select("dist_id", files.alias("files"), F.lit(None).cast("array<string>").alias("top_level_modules"), "build_backend", "backend_path")


def manifest_of(dists: DataFrame) -> DataFrame:
    """Members that are listed only."""
    return dists.select("dist_id", F.explode("files").alias("f")).where("f.text is null").select("dist_id", F.col("f.path").alias("rel_path"), "f.size_bytes")


def meta_of(dists: DataFrame) -> DataFrame:
    """IO-19: top-level modules and build backend of each distribution."""
    found = dists.select("dist_id", F.explode("files").alias("f")).groupBy("dist_id").agg(paths.top_level_modules(F.col("f.path")).alias("top_level_modules"))
    return dists.select("dist_id", "build_backend", "backend_path").join(found, "dist_id", "left")


def skipped_of(dists: DataFrame) -> DataFrame:
    return dists.where("reason is not null").select("dist_id", "reason", "detail")


def normalised_name(dists: DataFrame) -> DataFrame:
    return dists.withColumn("project", names.package_name(F.col("name")))
