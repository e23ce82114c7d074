import gzip
import io
import json
import tarfile

import pytest

from causeway import api
from causeway.plans.samples import PAIRS
from causeway.sources import archives
from causeway.sources.archives import Limits, read_sdist


def build(files: dict[str, str], top: str = "demo-1.0", extra=()) -> bytes:
    """IO-28: the same bytes for the same input."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for path in sorted(files):
            data = files[path].encode()
            m = tarfile.TarInfo(f"{top}/{path}" if top else path)
            m.size, m.mtime, m.mode = len(data), 0, 0o644
            t.addfile(m, io.BytesIO(data))
        for m in extra:
            t.addfile(m)
    return gzip.compress(raw.getvalue(), mtime=0)


def link(name, kind, target="/etc/passwd"):
    m = tarfile.TarInfo(name)
    m.type, m.linkname = kind, target
    return m


def test_well_formed():
    pkg = "Name: Demo\nVersion: 2.0\nRequires-Dist: a>=1\nRequires-Dist: b; extra == 'x'\n\nName: ignored\n"
    r = read_sdist("demo-1.0.tar.gz", build({"setup.py": "x = 1\n", "PKG-INFO": pkg, "demo/__init__.py": "", "data.bin": "zz", "pyproject.toml": "[build-system]\nbuild-backend = 'b'  # c\nbackend-path = [\n '.',\n 'x']\n"}))
    assert r.get("reason") is None and (r["name"], r["version"]) == ("Demo", "2.0")
    assert r["requires_dist"] == ["a>=1", "b; extra == 'x'"]
    assert [(f["path"], f["kind"]) for f in r["files"]] == [("PKG-INFO", None), ("data.bin", None), ("demo/__init__.py", "python"), ("pyproject.toml", "pyproject_toml"), ("setup.py", "setup_py")]
    assert (r["build_backend"], r["backend_path"]) == ("b", [".", "x"])


@pytest.mark.parametrize(
    "data",
    [
        build({"a.py": ""}, extra=[tarfile.TarInfo("../../x")]),
        build({"a.py": ""}, extra=[tarfile.TarInfo("/abs")]),
        build({"a.py": ""}, extra=[tarfile.TarInfo("C:x")]),
        build({"a.py": ""}, extra=[link("demo-1.0/l", tarfile.SYMTYPE)]),
        build({"a.py": ""}, extra=[link("demo-1.0/l", tarfile.LNKTYPE)]),
        build({"a.py": ""}, extra=[link("demo-1.0/l", tarfile.FIFOTYPE)]),
        build({"a.py": ""}, extra=[tarfile.TarInfo("other/x")]),
        b"not gzip",
        build({"a.py": "x"})[:40],
    ],
)
def test_hostile_archives_are_refused_whole(data):
    r = read_sdist("demo-1.0.tar.gz", data)
    assert r["reason"] == "extraction_failed" and r["files"] == []


def test_limits():
    data = build({f"f{k}.py": "x" * 100 for k in range(5)})
    assert read_sdist("demo-1.0.tar.gz", data, Limits(entries=4))["reason"] == "extraction_failed"
    assert read_sdist("demo-1.0.tar.gz", data, Limits(file_bytes=99))["reason"] == "extraction_failed"
    assert read_sdist("demo-1.0.tar.gz", data, Limits(total_bytes=300))["reason"] == "extraction_failed"
    bomb = build({"a.txt": "0" * 5_000_000})
    assert read_sdist("demo-1.0.tar.gz", bomb, Limits(total_bytes=1000, entries=1, file_bytes=1 << 30))["reason"] == "extraction_failed"
    assert read_sdist("x.whl", b"")["reason"] == "not_an_sdist"


def test_pyproject_lines():
    assert archives.pyproject("build-backend = 'no'\n[build-system]\nbuild-backend = \"m:api\"\n[x]\nbuild-backend='y'\n") == ("m:api", [])
    assert archives.pyproject("[build-system]\nbuild-backend = bare\n") == (None, [])


def test_scan_and_project(spark, tmp_path, capsys):
    bad = PAIRS["EXF-001"]["paint_mixer"][0]
    meta = lambda n, *needs: {"PKG-INFO": f"Name: {n}\nVersion: 1\n" + "".join(f"Requires-Dist: {x}\n" for x in needs)}
    sets = {"evil-1.tar.gz": bad | meta("evil"), "mid-1.tar.gz": {"setup.py": ""} | meta("mid", "evil>=1"), "top-1.tar.gz": {"setup.py": ""} | meta("top", "Mid", "evil; extra=='z'")}
    for name, files in sets.items():
        (tmp_path / name).write_bytes(build(files, name.removesuffix(".tar.gz")))
    (tmp_path / "bad-1.tar.gz").write_bytes(b"junk")
    found = {r["dist_id"]: r for r in api.scan_archives(spark, str(tmp_path)).collect()}
    assert found["evil-1.tar.gz"]["verdict"] == "malicious" and found["evil-1.tar.gz"]["distribution"]["name"] == "evil"
    assert found["bad-1.tar.gz"]["skipped"]["reason"] == "extraction_failed" and found["top-1.tar.gz"]["verdict"] == "clean"
    ranked = api.project(spark, str(tmp_path)).collect()
    assert [(r["name"], r["direct"], r["transitive"], r["share"]) for r in ranked] == [("evil", 2, 2, 2 / 3)]
    code = api.cli_main(["scan", "--json", str(tmp_path / "mid-1.tar.gz"), str(tmp_path / "evil-1.tar.gz")], spark)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert code == 1 and [x["dist_id"] for x in lines] == ["mid-1.tar.gz", "evil-1.tar.gz"]
    assert api.cli_main(["scan"], spark) == 2 and api.cli_main(["version"]) == 0


def test_directory_in_place(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("x = 1\n")
    (tmp_path / "setup.py").write_text("open('marker', 'w').write('x')\n")
    (tmp_path / "data.bin").write_bytes(b"\xff\xfe")
    rows = {r["path"]: r for r in archives.directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"pkg/__init__.py", "setup.py", "data.bin"} and rows["data.bin"]["text"] is None
    r = api.scan(spark, str(tmp_path))
    assert r["distribution"] is None and r["skipped"] is None
    assert not (tmp_path / "marker").exists()  # nothing scanned ever runs


def test_cache(spark, tmp_path, capsys):
    from causeway.operators.cache import Store, default_location

    box = tmp_path / "in"
    box.mkdir()
    (box / "evil-1.tar.gz").write_bytes(build(PAIRS["EXF-001"]["paint_mixer"][0], "evil-1"))
    (box / "plain-1.tar.gz").write_bytes(build({"setup.py": ""}, "plain-1"))
    store = Store(spark, str(tmp_path / "cache"))
    assert store.stats((6, 2)) == {"entries": 0, "stale": 0, "bytes": 0}
    runs = [sorted((r["dist_id"], r["cached"], r["report_json"]) for r in api.scan_cached(spark, str(box), store, day).collect()) for day in (100, 101)]
    assert [r[:2] for r in runs[0]] == [("evil-1.tar.gz", False), ("plain-1.tar.gz", False)]
    assert [(r[0], r[2]) for r in runs[1]] == [(r[0], r[2]) for r in runs[0]] and all(r[1] for r in runs[1])
    assert store.stats((6, 2))["entries"] == 2 and store.stats((7, 2))["stale"] == 2
    assert store.sweep((6, 2), 103, 5, None) == 0 and store.sweep((6, 2), 110, 5, None) == 2 and store.stats((6, 2))["entries"] == 0
    assert api.cli_main(["cache", "clear", "--path", str(tmp_path / "cache")], spark) == 0
    assert api.cli_main(["cache", "stats", "--path", str(tmp_path / "cache")], spark) == 0 and '"entries": 0' in capsys.readouterr().out
    assert default_location({"HOME": "/h"}) == "/h/.cache/causeway/results" and default_location({}) is None
