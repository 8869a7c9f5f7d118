"""Match finders against brute force; blocks, filter records and refined parses through the decoder."""

import random

from stowage.functions import lz50
from stowage.functions.matches import Chains, Tree, common, rebuilt


def _samples():
    r = random.Random(9)
    yield from (b"", b"a", b"abcd" * 60, b"\0" * 300)
    for size in (50, 400, 900):
        yield bytes(r.choice(b"ab") for _ in range(size))
        yield b"".join(r.choice((b"the ", b"quick ", b"brown ", b"fox ")) for _ in range(size // 4))


def test_longest():
    for data in _samples():
        chains, tree = Chains(data, depth=None), Tree(data, depth=None)
        for i in range(len(data)):
            true = max((common(data, j, i) for j in range(i)), default=0)
            found, walked = chains.longest(i), tree.place(i)
            chains.add(i)
            assert (found[0] if found else 0) == (true if true >= 4 and len(data) - i >= 4 else 0)
            assert (walked[-1][0] if walked else 0) == (found[0] if found else 0)
            assert all(data[i - d : i - d + n] == data[i : i + n] for n, d in walked)
        assert rebuilt(Chains(data).tokens(4094)) == data


def test_encoders():
    for data in _samples():
        size = len(data)
        assert lz50.Decoder().decode(b"".join(lz50.encode_blocks(data, 100)), size) == data
        small = lz50.encode_refined(data)
        assert lz50.Decoder().decode(small, size) == data and len(small) <= len(lz50.encode(data))
        assert rebuilt(lz50.refined(data)) == data
        for kind in range(4):
            half = size // 2
            filters = [(0, half, kind, 3), (half, size - half, 3 - kind, 2)] if size > 1 else []
            assert lz50.Decoder().decode(lz50.encode(data, filters=filters), size) == data
