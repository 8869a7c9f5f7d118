"""Recovery records inside containers of format 5+: planned, written, found again, and used for repair.

The bytes before the record are cut into shards of one even width; a chunk of the record holds one parity shard and the check
states of all data shards, so each chunk alone tells what is damaged, and as many chunks rebuild as many shards.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import formats as A
from . import recovery
from .checksums import _TABLE64, crc64

# The chunk's mark and fixed bytes, the most data shards, and the size from which there are that many
MARK, FIXED, MOST, KIB = b"{RB}", 72, 200, 1024
_LANES = np.array(_TABLE64, np.uint64)


@dataclass(frozen=True)
class Geometry:
    """size bytes in `data` shards of `width` bytes, with `parity` shards."""

    size: int
    data: int
    parity: int
    width: int

    @property
    def head(self) -> int:
        return FIXED + 8 * self.data

    @property
    def chunk(self) -> int:
        return self.head + self.width


def plan(size: int, percent: int) -> Geometry:
    """One shard a KiB up to 200 of them; at least one parity shard for small containers."""
    small = size < MOST * KIB
    data = max(1, -(-size // KIB)) if small else MOST
    parity = min(min(percent, 100) * data // 100, data)
    width = -(-size // data)
    return Geometry(size, data, parity or int(small), width + width % 2)


def shards(body: bytes, g: Geometry) -> list[bytes]:
    return [body[i * g.width : min((i + 1) * g.width, g.size)] for i in range(g.data)]


def states(pieces: list[bytes], width: int) -> list[int]:
    """Check registers of the pieces, all started at zero. Zeros in front leave such a register alone, so pieces run side by side."""
    rows = np.stack([np.frombuffer(p.rjust(width, b"\0"), np.uint8) for p in pieces]).astype(np.uint64)
    register = np.zeros(len(pieces), np.uint64)
    for column in rows.T:
        register = (register >> np.uint64(8)) ^ _LANES[((register ^ column) & np.uint64(255)).astype(np.intp)]
    return [int(r) for r in register]


def write_chunks(body: bytes, g: Geometry) -> bytes:
    pieces = shards(body, g)
    marks = states(pieces, g.width)
    parity = recovery.encode([p.ljust(g.width, b"\0") for p in pieces], g.parity)
    last = min(max(0, g.size - g.width * (g.data - 1)), g.width)
    table = struct.pack(f"<{g.data}Q", *marks) + struct.pack("<Q", states(parity[:1], g.width)[0])
    out = []
    for i, p in enumerate(parity):
        rest = struct.pack("<IIBB8xIQQQHHH", g.chunk, g.head, 1, 1, last, g.size, g.width, g.chunk, g.data, g.parity, i) + table + p
        out += [MARK, struct.pack("<Q", crc64(rest)), rest]
    return b"".join(out)


def _chunk(data: bytes, at: int) -> tuple[Geometry, int, tuple[int, ...], bytes] | None:
    """Geometry, index, states and parity of an intact chunk at a place."""
    if at + FIXED > len(data):
        return None
    total, head, major, minor, _, size, width, again, n, parity, index = struct.unpack_from("<IIBB8xIQQQHHH", data, at + 12)
    g = Geometry(size, n, parity, width)
    if (major, minor) != (1, 1) or not n or index >= parity or width % 2 or (total, head, again) != (g.chunk, g.head, g.chunk) or at + total > len(data):
        return None
    if struct.unpack_from("<Q", data, at + 4)[0] != crc64(data[at + 12 : at + total]):
        return None
    return g, index, struct.unpack_from(f"<{n}Q", data, at + 64), data[at + head : at + total]


def find_chunks(data: bytes) -> list[tuple[Geometry, int, tuple[int, ...], bytes]]:
    """Intact chunks wherever they stand: no header is needed. The geometry of the first one counts."""
    found: list = []
    at = data.find(MARK)
    while at >= 0:
        c = _chunk(data, at)
        if c is not None and (not found or c[0] == found[0][0]):
            found.append(c)
        at = data.find(MARK, at + (c[0].chunk if c else 1))
    return found


def record(body: bytes, g: Geometry, percent: int) -> bytes:
    """The service block that holds the chunks."""
    payload = write_chunks(body, g)
    check = struct.pack("<I", zlib.crc32(payload))
    fields = A.vint(4) + A.vint(len(payload)) + A.vint(0) + check + A.vint(0) + A.vint(1) + A.vint(2) + b"RR"
    return A.block50(3, 0, fields, A.extra50(7, A.vint(percent)), payload)


def protect(data: bytes, percent: int) -> bytes:
    """A container with a recovery record before its end block; an older record is left out."""
    blocks = [x for x in A.parse50(data, len(A.MARK50))]
    if not blocks or blocks[-1]["kind"] != "end":
        raise ValueError("the container has no end block")
    main, end = blocks[0], blocks[-1]
    volume = A.vint(main["time"]) if main["attr"] & 2 else b""
    extra = b"".join(A.extra50(e["type"], e["data"]) for e in main["extras"] if e["type"] != 1)
    keep = [data[x["offset"] : x["data_offset"] + x["packed"]] for x in blocks[1:-1] if x["name"] != b"RR" or x["kind"] != "service"]
    body = A.MARK50 + A.block50(1, 0, A.vint(main["attr"] | 8) + volume, extra) + b"".join(keep)
    return body + record(body, plan(len(body), percent), percent) + data[end["offset"] : end["data_offset"]]


def repair(data: bytes) -> tuple[bytes, dict]:
    """The container with its damaged shards solved, its record and end block written anew where they were hurt, and a report
    (chunks, damaged, rebuilt). ValueError where no chunk is intact or too few are."""
    chunks = find_chunks(data)
    if not chunks:
        raise ValueError("no intact recovery chunk")
    g, _, marks, _ = chunks[0]
    if g.size > len(data):
        raise ValueError("the record covers more than there is")
    body = data[: g.size]
    pieces = shards(body, g)
    bad = [i for i, s in enumerate(states(pieces, g.width)) if s != marks[i]]
    if bad:
        held = [None if i in set(bad) else p.ljust(g.width, b"\0") for i, p in enumerate(pieces)]
        parity = {i: p for _, i, _, p in chunks}
        back = recovery.reconstruct(held, sorted(parity.items()))
        if states([p[: len(q)] for p, q in zip(back, pieces, strict=True)], g.width) != list(marks):
            raise ValueError("the solved shards do not fit their states")
        body = b"".join(back)[: g.size]
    tail, behind = data[g.size :], b""
    blocks = list(A.parse50(tail, 0))
    intact = bool(blocks) and blocks[0]["kind"] == "service" and blocks[0]["name"] == b"RR" and blocks[0]["header_ok"] and len(chunks) == g.parity
    if intact:
        first = tail[: blocks[0]["data_offset"] + blocks[0]["packed"]]
    else:
        percent = next((p for p in range(1, 101) if plan(g.size, p).parity == g.parity), 100)
        if blocks and blocks[0]["header_ok"] and blocks[0]["extras"]:  # the percentage that was asked for
            percent = next((A.read_vint(e["data"], 0)[0] for e in blocks[0]["extras"] if e["type"] == 7), percent)
        first = record(body, g, percent)
    behind = tail[len(first) :]
    ends = list(A.parse50(behind, 0))
    whole = bool(ends) and ends[-1]["kind"] == "end" and all(x["header_ok"] for x in ends)
    if not whole:
        behind = A.block50(5, 0, A.vint(0))
    return body + first + behind, {"chunks": len(chunks), "damaged": len(bad), "rebuilt": not intact, "end_rebuilt": not whole}
