import json

from causeway.plans.samples import PAIRS
from causeway.streaming import arrivals
from tests.test_archives import build


def test_each_archive_once(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "evil-1.tar.gz").write_bytes(build(PAIRS["EXF-001"]["paint_mixer"][0], "evil-1"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name in (None, "plain-1.tar.gz", "evil-2.tar.gz"):
        if name == "plain-1.tar.gz":
            (box / name).write_bytes(build({"setup.py": ""}, "plain-1"))
        elif name:  # the same bytes under another name
            (box / name).write_bytes((box / "evil-1.tar.gz").read_bytes())
        q = arrivals.watch(spark, str(box), out, check)
        q.processAllAvailable()
        q.stop()
    rows = [json.loads(r["report_json"]) for r in spark.read.parquet(out).collect()]
    assert sorted((r["dist_id"], r["verdict"]) for r in rows) == [("evil-1.tar.gz", "malicious"), ("plain-1.tar.gz", "clean")]
