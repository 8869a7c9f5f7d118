"""Recovery records: geometry, states, and repair of damage in payloads, headers, the record and the end."""

import random

import pytest

from stowage.functions import formats as A
from stowage.functions import inline
from stowage.functions.checksums import crc64

ONES = (1 << 64) - 1


def test_geometry():
    assert inline.plan(1, 1) == inline.Geometry(1, 1, 1, 2)
    assert inline.plan(5000, 10) == inline.Geometry(5000, 5, 1, 1000)
    assert inline.plan(1 << 20, 3) == inline.Geometry(1 << 20, 200, 6, 5244)
    assert inline.plan(300 << 10, 0).parity == 0


def test_states():
    assert inline.states([b"te\x80st"], 6) == [0xB5DBF9583A6EED4A]
    r = random.Random(3)
    pieces = [r.randbytes(n) for n in (64, 64, 0, 7)]
    assert inline.states(pieces, 64) == [crc64(p, ONES) ^ ONES for p in pieces]


def test_repair():
    r = random.Random(4)
    data = A.write50([{"name": f"f{k}".encode(), "payload": r.randbytes(3000)} for k in range(10)])
    whole = inline.protect(data, 10)
    assert [x["kind"] for x in A.parse(whole)].count("service") == 1 and all(x["header_ok"] for x in A.parse(whole))
    same, report = inline.repair(whole)
    assert same == whole and report["damaged"] == 0 and not report["rebuilt"]
    assert inline.protect(whole, 10) == whole
    size = inline.find_chunks(whole)[0][0].size

    def hurt(*places):
        b = bytearray(whole)
        for p in places:
            b[p] ^= 0x55
        return bytes(b)

    for places, damaged, rebuilt in (((12,), 1, False), ((12, 9000, 20000), 3, False), ((size + 4,), 0, True), ((size + 200,), 0, True), ((9000, size + 200), 1, True), ((len(whole) - 3,), 0, False)):
        back, report = inline.repair(hurt(*places))
        assert back == whole and report["damaged"] == damaged and report["rebuilt"] == rebuilt
    assert inline.repair(whole[:-4])[0] == whole
    for bad in (hurt(*range(2000, 8000, 1000)), data, b"", hurt(*range(size, len(whole), 40))):
        with pytest.raises(ValueError):
            inline.repair(bad)
