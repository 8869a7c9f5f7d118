"""Plans: encrypted members, settings, errors; empty, null and odd cases."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import formats as A
from stowage.functions.aes import Cbc
from stowage.functions.ciphers import keys50
from stowage.plans.facade import CODES, ArchiveError, ArchiveFrame, ArchivePlan, ReadOptions


def test_encrypted_members(spark):
    rows = [("x", k, f"n{k}".encode(), p) for k, p in enumerate((b"", b"short", b"s" * 16, b"long" * 100, None))]
    m = spark.createDataFrame(rows, "archive string, member_index long, name binary, payload binary")
    plan = ArchivePlan(m).encrypt(m.where("member_index != 1").withColumn("password", F.lit("right")))
    built = plan.build(5).withColumnRenamed("archive", "path")
    data = bytes(built.first().content)
    assert bytes(plan.build(5).first().content) == data  # reruns agree
    blocks = [x for x in A.parse(data) if x["kind"] == "file"]
    assert [x["is_encrypted"] for x in blocks] == [True, False, True, True, False]
    record = blocks[3]["extras"][0]["data"]  # against the plain implementation
    piece = data[blocks[3]["data_offset"] : blocks[3]["data_offset"] + blocks[3]["packed"]]
    assert Cbc(keys50(b"right", record[3:19], 5)["key"]).decrypt(piece, record[19:35])[:400] == b"long" * 100
    read = {r.member_index: (r.payload and bytes(r.payload), r.code) for r in ArchiveFrame(built, ReadOptions(password=b"right")).read_many().collect()}
    assert [read[k][0] or b"" for k in range(5)] == [p or b"" for *_, p in rows] and not any(c for _, c in read.values())
    wrong = {r.member_index: r.code for r in ArchiveFrame(built, ReadOptions(password=b"wrong")).read_many().collect()}
    assert [wrong[k] for k in range(5)] == ["BAD_PASSWORD", None, "BAD_PASSWORD", "BAD_PASSWORD", None]
    none = {r.member_index: r.code for r in ArchiveFrame(built).read_many().collect()}
    assert none[3] == "PASSWORD_REQUIRED" and none[1] is None
    assert ArchiveFrame(built).needs_password().first().needs_password


def test_settings_alone(spark):
    s = spark.createDataFrame([("e", b"words", True)], "archive string, comment binary, locked boolean")
    out = ArchivePlan.new(spark).set_archives(s).build().withColumnRenamed("archive", "path")
    a = ArchiveFrame(out)
    assert bytes(a.comment().first().comment) == b"words" and a.members().count() == 0 and a.errors().count() == 0
    kept = a.preserving_plan().settings.first()
    assert kept.locked and bytes(kept.comment) == b"words" and kept.title is None


def test_errors(spark):
    c = spark.createDataFrame([("none", b"nothing"), ("empty", None), ("cut", A.write50([])[:12])], "path string, content binary")
    assert {(r.path, r.code) for r in ArchiveFrame(c).errors().collect()} >= {("none", "UNSUPPORTED_FORMAT"), ("empty", "UNSUPPORTED_FORMAT"), ("cut", "INVALID_ARCHIVE")}
    assert len(CODES) == len(set(CODES.values())) == 15
    with pytest.raises(ArchiveError) as e:
        ReadOptions(max_header_count=-1)
    assert e.value.code == "INVALID_OPTION"
    with pytest.raises(ArchiveError):
        ArchivePlan.new(spark, "6")
