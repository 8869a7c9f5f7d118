"""AES by published vectors; sealed containers: walk, probe, trial."""

from stowage.functions import formats as A
from stowage.functions import sealed
from stowage.functions.aes import Cbc


def test_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, want in (("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")):
        c = Cbc(bytes.fromhex(key))
        assert c.encrypt(plain, bytes(16)).hex() == want and c.decrypt(bytes.fromhex(want), bytes(16)) == plain
    c = Cbc(bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"))
    assert c.encrypt(bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"), bytes(range(16))).hex() == "f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d"


def test_sealed_containers():
    data = A.write50([{"name": f"f{k}".encode(), "payload": b"x" * k} for k in range(5)])
    for with_check in (True, False):
        s = sealed.seal(data, b"right", bytes(range(16)), 4, with_check)
        assert sealed.matches(s, b"right") == "correct" and sealed.matches(s, b"guess") == "wrong"
        open_, found = list(A.parse50(data, len(A.MARK50))), list(sealed.walk(s, b"right"))
        assert [(x["kind"], x["name"], x["packed"], x["header_ok"]) for x in found] == [(x["kind"], x["name"], x["packed"], x["header_ok"]) for x in open_]
        assert all(A.payload_ok(x, s[x["data_offset"] : x["data_offset"] + x["packed"]]) for x in found if x["kind"] == "file")
        assert [x["kind"] for x in sealed.walk(s, b"guess")] == ["cut"]
        assert list(sealed.walk(s[:-4], b"right"))[-1]["kind"] == "cut"
    assert sealed.probe(data) is None and sealed.matches(data, b"x") == "undetermined"


def test_sealed_format_3():
    data = A.write15([{"name": f"f{k}".encode() * (k + 1), "payload": b"x" * k} for k in range(5)])
    s = sealed.seal15(data, b"right", bytes(range(8)))
    open_, found = list(A.parse(data)), list(sealed.walk15(s, b"right"))
    assert [(x["kind"], x["name"], x["packed"], x["header_ok"]) for x in found] == [(x["kind"], x["name"], x["packed"], x["header_ok"]) for x in open_]
    assert all(A.payload_ok(x, s[x["data_offset"] : x["data_offset"] + x["packed"]]) for x in found if x["kind"] == "file")
    assert [x["kind"] for x in sealed.walk15(s, b"guess")] == ["main", "cut"]
    assert list(sealed.walk15(s[:-4], b"right"))[-1]["kind"] == "cut"
    assert list(sealed.walk15(data, b"any")) == open_
