"""Byte kernels against published vectors, inverses and other implementations."""

import random
import zlib

from stowage.functions import checksums as C
from stowage.functions import filters as X


def test_crc32_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(200)), rng.randbytes(rng.randrange(200))
        assert C.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert C.combine(zlib.crc32(b"x"), zlib.crc32(bytes(100000)), 100000) == zlib.crc32(b"x" + bytes(100000))


def test_crc64():
    assert C.crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_blake2sp_empty():
    assert C.blake2sp(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


def test_delta_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 5, 64, 1000):
        for channels in (1, 2, 3, 7, 32):
            data = rng.randbytes(n)
            assert X.delta_decode(X.delta_encode(data, channels), channels) == data


def test_branch_filters_round_trip():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice([0xE8, 0xE9, 0, 1, 0xFF, 0xEB, rng.randrange(256)]) for _ in range(rng.randrange(300)))
        offset = rng.choice([0, 4, 4096, (1 << 24) - 8])
        for e9 in (False, True):
            assert X.x86_decode(X.x86_encode(data, offset, e9), offset, e9) == data
        assert X.arm_decode(X.arm_encode(data, offset), offset) == data
