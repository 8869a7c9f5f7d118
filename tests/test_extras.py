"""Typed records: round trips and damage."""

import random
import struct

import pytest

from stowage.functions import extras as E


def test_records():
    for q, r in ((None, None), (5, None), (None, 300), (1 << 40, 7)):
        assert E.read_locator(E.write_locator(q, r)) == {"quick_open": q, "recovery": r}
    assert E.read_metadata(E.write_metadata(b"name", ticks=123)) == {"name": b"name", "ticks": 123}
    assert E.read_metadata(E.write_metadata(None, unix=1)) == {"name": None, "ticks": E.EPOCH_TICKS + 10_000_000}


def test_times():
    r = random.Random(1)
    for _ in range(300):
        ns = {k: r.choice([r.randrange(1 << 62), r.randrange(1 << 32) * 1_000_000_000, -r.randrange(10**17) * 100]) for k in E.NAMES if r.random() < 0.7}
        unix = all(0 <= x // 1_000_000_000 < 1 << 32 for x in ns.values())
        if not unix and any(x % 100 for x in ns.values()):
            with pytest.raises(ValueError):
                E.write_times(ns)
        else:
            assert E.read_times(E.write_times(ns)) == ns


def test_extended_times():
    times = [(77, 1234567), None, (99, 15_000_000), (5, 0)]
    assert E.read_extended(E.write_extended(times), 77) == times
    with pytest.raises(struct.error):
        E.read_extended(E.write_extended(times)[:6], 77)
