"""Containers, ciphers, recovery, streaming and the facade: round trips, damage, published vectors."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.functions import ciphers as C
from stowage.functions import formats as A
from stowage.functions import namecodecs as N
from stowage.functions import recovery as R
from stowage.plans.facade import ArchiveFrame
from stowage.sources.archives import ArchiveSource
from stowage.streaming import volumes as V

RNG = random.Random(1)
MEMBERS = [{"name": f"dir/f{i}.txt".encode(), "payload": RNG.randbytes(i * 37), "mtime": 1000 + i} for i in range(6)]


@pytest.mark.parametrize("write", [A.write50, A.write15, A.write13])
def test_round_trip_and_damage(write):
    data = b"stub" * 9 + write(MEMBERS)
    files = [x for x in A.parse(data) if x["kind"] == "file"]
    assert [x["name"] for x in files] == [m["name"] for m in MEMBERS]
    for x, m in zip(files, MEMBERS, strict=True):
        piece = data[x["data_offset"] : x["data_offset"] + x["packed"]]
        assert piece == m["payload"] and x["header_ok"] and A.payload_ok(x, piece)
        if piece:
            assert not A.payload_ok(x, bytes([piece[0] ^ 1]) + piece[1:])
    for end in range(len(data)):
        rows = list(A.parse(data[:end]))
        assert rows and all(r["kind"] for r in rows)
    for _ in range(200):
        at = RNG.randrange(len(data))
        list(A.parse(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]))


def test_vint():
    for n in (0, 1, 127, 128, 129, 1 << 35, (1 << 64) - 1):
        assert A.read_vint(A.vint(n), 0) == (n, len(A.vint(n)))
    for bad in (b"", b"\x81", b"\xff" * 10, b"\xff" * 9 + b"\x7f"):
        with pytest.raises(ValueError):
            A.read_vint(bad, 0)


def test_hash_beats_crc_and_version_renames():
    from stowage.functions.checksums import blake2sp

    data = A.write50([{"name": b"a", "payload": b"x", "crc": 5, "hash": blake2sp(b"x"), "version": 3}])
    x = next(r for r in A.parse(data) if r["kind"] == "file")
    assert x["name"] == b"a;3" and A.payload_ok(x, b"x") and not A.payload_ok(x, b"y")


def test_signature_precedence():
    assert A.find_signature(A.MARK13 + b"zz" + A.MARK15) == ("1.5-4", 6, 7)
    assert A.find_signature(b"zz" + A.MARK13) == ("1.3", 2, 4)
    assert A.find_signature(b"nothing") is None


def test_ciphers(spark):
    assert C.crypt13(b"hello world", C.key13(b"password"), False).hex() == "37cdaabd104e6f6eb530e6"
    assert C.crypt15(b"hello world", b"password").hex() == "2bb9f39c41a6aae71a7a7b"
    key, iv = C.keys30(b"password", bytes(range(1, 9)))
    one = spark.range(1)
    sealed = one.select(C.aes_encrypt_raw(F.lit(b"0123456789abcdefRAR AES CBC data"), F.lit(key), F.lit(iv)).alias("x"))
    assert bytes(sealed.first().x).hex() == "5e59cea116caa21d4dc505eba93f7bcd0d04ffea60673daf6a8f02b203c87dde"
    assert bytes(sealed.select(C.aes_decrypt_raw(F.col("x"), F.lit(key), F.lit(iv)).alias("y")).first().y) == b"0123456789abcdefRAR AES CBC data"
    k = C.keys50(b"pw", bytes(16), 5)
    assert C.verdict(k["check"], C.check_record(k["check"])) == "correct"
    assert C.verdict(k["check"], C.check_record(bytes(7) + b"x")) == "wrong" and C.verdict(k["check"], bytes(12)) == "undetermined"


def test_names():
    for name in (b"plain", "ü".encode(), b"\xff\x80x", "￾".encode()):
        assert N.decode_marked(N.encode_marked(name)) == name
    for name in ("a.txt", "ünïcode/日本.txt", "x" * 50):
        assert A.legacy_name(N.encode_packed(name), True).decode() == name
    assert N.decode_legacy(b"\x81", "windows-1252") is None and N.decode_legacy(b"\x81", "cp437") == "ü"


@pytest.mark.parametrize("field", [R.GF16, R.GF8])
def test_reconstruct(field):
    data = [RNG.randbytes(64) for _ in range(9)]
    parity = R.encode(data, 4, field)
    lost = [None if i in (0, 4, 8) else d for i, d in enumerate(data)]
    assert R.reconstruct(lost, [(1, parity[1]), (2, parity[2]), (3, parity[3])], field) == data
    with pytest.raises(ValueError):
        R.reconstruct(lost, [(0, parity[0])], field)
    assert R.GF16.multiply(0x8000, 2) == 0x100B


def test_recovery_volume():
    x = A.parse_rev(A.write_rev(2, [(5, 6), (7, 8)], 1, b"abc"))
    assert x["ok"] and x["shards"] == [(5, 6), (7, 8)] and x["payload"] == b"abc" and x["number"] == 2


def test_facade_and_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(A.write50(MEMBERS))
    (tmp_path / "b.bin").write_bytes(A.write15(MEMBERS)[:-20])
    (tmp_path / "c.txt").write_bytes(b"no archive")
    f = ArchiveFrame.open(spark, str(tmp_path))
    assert f.namelist().count() == 11 or f.namelist().count() == 12
    assert bytes(f.read(b"dir/f3.txt").where("path like '%a.bin'").first().payload) == MEMBERS[3]["payload"]
    assert {r.path[-5:]: r.is_archive for r in f.is_archive().collect()} == {"a.bin": True, "b.bin": True, "c.txt": False}
    assert f.test().where("path like '%a.bin'").first().damaged == 0
    assert f.select(["f1.txt"]).count() == 2
    plan = ArchiveFrame(spark.createDataFrame([("x", A.write50(MEMBERS))], "path string, content binary")).plan()
    gone = spark.createDataFrame([(0,), (2,)], "member_index int")
    out = plan.remove(gone).build()
    again = ArchiveFrame(out.withColumnRenamed("archive", "path"))
    assert again.namelist().count() == 4 and again.test().first().damaged == 0
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").option("path", str(tmp_path / "a.bin")).load()
    assert rows.where("kind = 'file'").count() == 6 and zlib.crc32(MEMBERS[2]["payload"]) in [r.check_value for r in rows.collect()]


def test_volume_stream(spark, tmp_path, only_data_batches):
    r = random.Random(3)
    rows = []
    for s in range(12):
        n = r.randrange(1, 6)
        rows += [(s, v, 10 + v, v == n - 1) for v in range(n) if not (s % 4 == 1 and v == 1)]
    for k in range(3):  # three files, volumes of a set in order
        part = spark.createDataFrame([x for i, x in enumerate(sorted(rows, key=lambda x: x[1])) if i * 3 // len(rows) == k], V.INPUT)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(V.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = V.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(x.set_id, x.first_volume, x.last_volume, x.packed_size) for x in spark.table("folded").where("status = 'complete'").collect()}
    want = set()
    for s in {x[0] for x in rows}:
        out, _ = V.advance(s, None, [x[1:] for x in rows if x[0] == s])
        want |= {(o[0], o[1], o[2], o[4]) for o in out if o[5] == "complete"}
    assert got == want


def test_out_of_order():
    out, run = V.advance(1, (0, 2, 3, 30), [(1, 5, False), (4, 7, False)])
    assert [o[5] for o in out] == ["out_of_order", "missing_volume"] and run == (4, 4, 1, 7)
