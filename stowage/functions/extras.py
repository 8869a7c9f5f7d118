"""Typed records: locator and metadata of a main header, times of a member, and the time extension of format 3."""

from __future__ import annotations

import struct

from .formats import read_vint, vint
from .times import EPOCH_TICKS


def write_locator(quick_open: int | None, recovery: int | None) -> bytes:
    flags = (quick_open is not None) | (recovery is not None) << 1
    return vint(flags) + b"".join(vint(x) for x in (quick_open, recovery) if x is not None)


def read_locator(data: bytes) -> dict[str, int | None]:
    flags, at = read_vint(data, 0)
    out: dict[str, int | None] = {"quick_open": None, "recovery": None}
    for bit, name in ((1, "quick_open"), (2, "recovery")):
        if flags & bit:
            out[name], at = read_vint(data, at)
    return out


def write_metadata(name: bytes | None, ticks: int | None = None, unix: int | None = None) -> bytes:
    flags = (name is not None) | (2 if ticks is not None or unix is not None else 0) | (4 if unix is not None else 0)
    out = vint(flags)
    if name is not None:
        out += vint(len(name)) + name
    if unix is not None:
        return out + struct.pack("<I", unix)
    return out + (struct.pack("<Q", ticks) if ticks is not None else b"")


def read_metadata(data: bytes) -> dict:
    """name and creation time in ticks of 100 ns since 1601."""
    flags, at = read_vint(data, 0)
    out: dict = {"name": None, "ticks": None}
    if flags & 1:
        n, at = read_vint(data, at)
        out["name"], at = data[at : at + n], at + n
    if flags & 2:
        if flags & 4:
            ns = flags & 8
            value = struct.unpack_from("<Q" if ns else "<I", data, at)[0]
            out["ticks"] = EPOCH_TICKS + (value // 100 if ns else value * 10_000_000)
        else:
            out["ticks"] = struct.unpack_from("<Q", data, at)[0]
    return out


NAMES = ("modified", "created", "accessed")


def write_times(ns: dict[str, int]) -> bytes:
    """The record of up to three times in Unix nanoseconds: Unix seconds with fractions where all fit, else ticks."""
    unix = all(0 <= v < 1 << 32 for v in (x // 1_000_000_000 for x in ns.values()))
    fraction = unix and any(x % 1_000_000_000 for x in ns.values())
    flags = unix | sum(2 << i for i, k in enumerate(NAMES) if k in ns) | (16 if fraction else 0)
    own = [ns[k] for k in NAMES if k in ns]
    if not unix:
        if any(x % 100 for x in own):
            raise ValueError("ticks need a precision of 100 ns")
        return vint(flags) + b"".join(struct.pack("<Q", x // 100 + EPOCH_TICKS) for x in own)
    out = vint(flags) + b"".join(struct.pack("<I", x // 1_000_000_000) for x in own)
    return out + (b"".join(struct.pack("<I", x % 1_000_000_000) for x in own) if fraction else b"")


def read_times(data: bytes) -> dict[str, int]:
    flags, at = read_vint(data, 0)
    names, out = [k for i, k in enumerate(NAMES) if flags & 2 << i], {}
    for k in names:
        if flags & 1:
            out[k], at = struct.unpack_from("<I", data, at)[0] * 1_000_000_000, at + 4
        else:
            out[k], at = (struct.unpack_from("<Q", data, at)[0] - EPOCH_TICKS) * 100, at + 8
    if flags & 1 and flags & 16:
        for k in names:
            out[k], at = out[k] + struct.unpack_from("<I", data, at)[0] % (1 << 30), at + 4
    return out


def read_extended(data: bytes, dos: int) -> list[tuple[int, int] | None]:
    """Four times (modified, created, accessed, archived) as (DOS word, 100 ns since it): a nibble each, from the top; `dos` is the header's own word."""
    flags, at = struct.unpack_from("<H", data, 0)[0], 2
    out: list[tuple[int, int] | None] = []
    for k in range(4):
        nibble = flags >> (12 - 4 * k) & 15
        if not nibble & 8:
            out.append(None)
            continue
        word = dos
        if k:
            word, at = struct.unpack_from("<I", data, at)[0], at + 4
        n = nibble & 3
        fraction = int.from_bytes(bytes(3 - n) + data[at : at + n], "little")
        at += n
        out.append((word, fraction + (10_000_000 if nibble & 4 else 0)))
    return out


def write_extended(times: list[tuple[int, int] | None]) -> bytes:
    flags, out = 0, b""
    for k, t in enumerate(times):
        if t is None:
            continue
        word, more = t
        second, fraction = more >= 10_000_000, more % 10_000_000
        flags |= (8 | (4 if second else 0) | 3) << (12 - 4 * k)
        out += (struct.pack("<I", word) if k else b"") + fraction.to_bytes(3, "little")
    return struct.pack("<H", flags) + out
