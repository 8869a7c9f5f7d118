"""Extraction to files, and the filters of bundles and pictures."""

import os
import random

from pyspark.sql import functions as F

from stowage.functions import filters as X
from stowage.functions import formats as A
from stowage.sources import sinks
from stowage.sources.archives import members_of, read_blocks


def test_extract(spark, tmp_path):
    ms = [{"name": n, "payload": p} for n, p in ((b"a/x.txt", b"one"), (b"a/x.txt", b"two"), (b"../evil", b"no"), (b"b\\y", b"three"), (b"bad", b"four"))]
    data = A.write50(ms)
    at = data.rindex(b"four")
    data = data[:at] + b"f0ur" + data[at + 4 :]
    m = members_of(read_blocks(spark.createDataFrame([("s", data)], "path string, content binary"), payload=True))
    out = str(tmp_path / "out")
    os.mkdir(out)
    status = sorted(r.status for r in sinks.extract_to(sinks.plan_targets(m), out).collect())
    assert status == ["damaged", "refused", "refused", "written", "written"]
    assert open(f"{out}/a/x.txt", "rb").read() == b"one" and open(f"{out}/b/y", "rb").read() == b"three"
    assert sorted(r.status for r in sinks.extract_to(sinks.plan_targets(m), out).collect())[1] == "exists"
    sinks.extract_to(sinks.plan_targets(m, "always"), out, "always").collect()
    assert open(f"{out}/a/x.txt", "rb").read() == b"two"
    with open(f"{out}/b/y", "w") as f:
        f.write("mine")
    report = sinks.extract_to(sinks.plan_targets(m, "rename").where("member_index = 3"), out, "rename")
    assert [(r.target, r.status) for r in report.collect()] == [("b/y(1)", "written")] and open(f"{out}/b/y").read() == "mine"
    first = sinks.extract_to(sinks.plan_targets(m).where("member_index = 3").withColumn("target", F.lit("new/z")), out)
    assert [r.status for r in first.collect()] == [r.status for r in first.collect()] == ["written"]  # a retried task
    targets = [r.target for r in sinks.plan_targets(m, "rename").orderBy("member_index").collect()]
    assert targets[:2] == ["a/x.txt", "a/x(1).txt"] and targets[2] is None
    assert [r.target for r in sinks.plan_targets(m, flat=True).orderBy("member_index").collect()] == ["x.txt", None, None, "y", "bad"]
    os.symlink("/tmp", f"{out}/link")
    evil = m.limit(1).withColumn("target", F.lit("link/z"))
    assert sinks.extract_to(evil, out).first().status == "unsafe"
    sinks.drop_staging(out)
    assert not [f for f in os.listdir(out) if f.startswith(".staging")]


def test_bundles_and_pictures():
    r = random.Random(5)
    for _ in range(60):
        data = r.randbytes(r.randrange(200))
        assert X.itanium_decode(X.itanium_encode(data, 160), 160) == data
        for width in (3, 12, 48):
            assert X.rgb_decode(X.rgb_encode(data, width, 1), width, 1) == data


def test_links_and_places(tmp_path):
    root = os.path.realpath(tmp_path / "root")
    os.makedirs(f"{root}/d")
    with open(f"{root}/d/f", "w") as f:
        f.write("text")
    assert sinks.safe_join(root, "d/f") == f"{root}/d/f" and sinks.safe_join(root, "../x") is None and sinks.safe_join(root, ".") is None
    assert sinks.make_link(root, "l/s", "symlink", "../d/f") == sinks.make_link(root, "l/s", "symlink", "../d/f") == "written"
    assert sinks.make_link(root, "l/h", "hard link", "d/f") == sinks.make_link(root, "l/h", "hard link", "d/f") == "written"
    assert sinks.make_link(root, "l/c", "copy", "d/f") == "written" and sinks.make_link(root, "l/c", "copy", "d/f") == "exists"
    assert all(open(f"{root}/l/{k}").read() == "text" for k in "shc")
    assert sinks.make_link(root, "l/x", "symlink", "/etc/passwd") == sinks.make_link(root, "l/x", "symlink", "../../up") == sinks.make_link(root, "../x", "copy", "d/f") == "unsafe"
    assert sinks.make_link(root, "l/x", "copy", "d/none") == "missing"
    assert sinks.make_link(root, "l/h", "hard link", "d/f", "always") == "written" and sorted(os.listdir(f"{root}/l")) == ["c", "h", "s"]
    os.symlink("d", f"{root}/to")
    assert sinks.safe_join(root, "to/new") is None and sinks.make_link(root, "to/new", "copy", "d/f") == "unsafe"


def test_in_place(spark, tmp_path):
    out = str(tmp_path)
    m = spark.createDataFrame([("p", "a", b"one", True), ("p", "b", b"tw", False)], "path string, target string, payload binary, payload_ok boolean")
    assert sorted(r.status for r in sinks.extract_to(m, out, "always", in_place=True).collect()) == ["damaged", "written"]
    assert open(f"{out}/b").read() == "tw"
    assert sorted(r.status for r in sinks.extract_to(m, out, "never", in_place=True).collect()) == ["exists", "exists"]
