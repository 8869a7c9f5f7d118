"""Repairs of sectors whose damage keeps the tag of 16 bits."""

import zlib

import numpy as np

from stowage.functions.bytemaps import SECTOR, tagged_repairs


def test_damage_that_keeps_the_tag():
    damaged = zlib.crc32(b"\xff" + bytes(SECTOR - 1)) & 0xFFFF
    texts = (str(k).encode().rjust(SECTOR, b"x") for k in range(1 << 20))
    second = next(t for t in texts if zlib.crc32(t) & 0xFFFF == damaged)
    for tail in (b"", b"short", bytes(range(256)) * 5):
        assert tagged_repairs(np.frombuffer(b"a" * SECTOR + second + tail, np.uint8)) == 1
    assert tagged_repairs(np.frombuffer(second, np.uint8)) == 0  # there is no second sector
