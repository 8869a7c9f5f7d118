"""Compressed payloads: round trips, solid chains, damage, filters."""

import random

import pytest

from stowage.functions import lz50 as Z

TEXT = ("the quick brown fox jumps over the lazy dog, and then again; " * 40).encode()


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 300, TEXT, bytes(range(256)) * 3, bytes(5000), random.Random(1).randbytes(3000)])
@pytest.mark.parametrize("matches", [False, True])
def test_round_trip(data, matches):
    packed = Z.encode(data, matches)
    assert Z.Decoder().decode(packed, len(data)) == data
    if data is TEXT and matches:
        assert len(packed) < len(data) / 5


def test_solid_chain_and_far_matches():
    d = Z.Decoder()
    for k in range(3):
        assert d.decode(Z.encode(TEXT[k:]), len(TEXT) - k) == TEXT[k:]
    far = random.Random(2).randbytes(9000) + TEXT
    data = far + random.Random(3).randbytes(70000) + far
    assert Z.Decoder().decode(Z.encode(data), len(data)) == data


def test_damage():
    packed = Z.encode(TEXT)
    for end in range(0, len(packed) - 1, 3):
        with pytest.raises((ValueError, IndexError)):
            Z.Decoder().decode(packed[:end] or b"\0", len(TEXT))
    with pytest.raises(ValueError):
        Z.Decoder().decode(bytes([packed[0] ^ 8]) + packed[1:], len(TEXT))


def test_code_lengths():
    lengths = Z.code_lengths([1 << k for k in range(30)])
    assert max(lengths) <= 15 and abs(sum(2.0**-n for n in lengths if n)) <= 1
    assert Z.code_lengths([0, 5, 0]).count(1) == 2
