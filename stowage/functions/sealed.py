"""Containers with encrypted headers: written, probed for a password, and walked. First format 5+, then format 3.

After the signature comes one open header with the salt, the rounds and the password's check; every later header
follows its own initial vector, filled up to whole blocks. Payloads lie between them as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

from . import formats as A
from .aes import Cbc
from .ciphers import check_record, keys30, keys50, verdict

KIND = 4  # fixed value: the type of the open header


def _vector(key: bytes, place: int) -> bytes:
    """An initial vector of our own for each header."""
    return hashlib.sha256(key + place.to_bytes(8, "little")).digest()[:16]


def seal(data: bytes, password: bytes, salt: bytes, log_rounds: int, with_check: bool = True) -> bytes:
    """An open container with its headers encrypted."""
    k = keys50(password, salt, log_rounds)
    body = A.vint(0) + A.vint(1 if with_check else 0) + bytes((log_rounds,)) + salt + (check_record(k["check"]) if with_check else b"")
    out, cipher = [A.MARK50, A.block50(KIND, 0, body)], Cbc(k["key"])
    for x in A.parse50(data, len(A.MARK50)):
        header = data[x["offset"] : x["data_offset"]]
        iv = _vector(k["key"], x["offset"])
        out += [iv, cipher.encrypt(header.ljust(-(-len(header) // 16) * 16, b"\0"), iv), data[x["data_offset"] : x["data_offset"] + x["packed"]]]
    return b"".join(out)


def probe(data: bytes) -> dict | None:
    """salt, log_rounds, check record and first byte behind the open header; only that header is read. None if headers are not encrypted."""
    at = len(A.MARK50)
    if not data.startswith(A.MARK50) or len(data) < at + 8:
        return None
    size, body = A.read_vint(data, at + 4)
    end = body + size
    kind, at = A.read_vint(data, body)
    if kind != KIND:
        return None
    _, at = A.read_vint(data, at)
    _, at = A.read_vint(data, at)
    flags, at = A.read_vint(data, at)
    rounds, salt = data[at], data[at + 1 : at + 17]
    return {"salt": salt, "log_rounds": rounds, "check": data[at + 17 : at + 29] if flags & 1 else bytes(12), "end": end}


def _header(data: bytes, at: int, cipher: Cbc) -> tuple[bytes, int]:
    """The header behind the vector at a place, and the place behind its last block."""
    iv, at = data[at : at + 16], at + 16
    if at + 16 > len(data):
        raise ValueError("header is cut short")
    head = cipher.decrypt(data[at : at + 16], iv)
    size, body = A.read_vint(head, 4)
    whole = -(-(body + size) // 16) * 16
    if at + whole > len(data) or not size:
        raise ValueError("header is cut short")
    return (head + cipher.decrypt(data[at + 16 : at + whole], data[at : at + 16]))[: body + size], at + whole


def matches(data: bytes, password: bytes, keys: dict | None = None) -> str:
    """correct, wrong or undetermined: by the check record, or by the check value of the first header, which is decrypted for trial."""
    if (p := probe(data)) is None:
        return "undetermined"
    keys = keys or keys50(password, p["salt"], p["log_rounds"])
    if (found := verdict(keys["check"], p["check"])) != "undetermined":
        return found
    try:
        head, _ = _header(data, p["end"], Cbc(keys["key"]))
    except (ValueError, IndexError):
        return "wrong"
    return "correct" if zlib.crc32(head[4:]) == struct.unpack_from("<I", head)[0] else "wrong"


def walk(data: bytes, password: bytes, keys: dict | None = None) -> Iterator[dict]:
    """The blocks of a sealed container, with the columns of the open walk; the key is derived once, or given."""
    p = probe(data)
    if p is None:
        yield from A.parse(data)
        return
    keys = keys or keys50(password, p["salt"], p["log_rounds"])
    if verdict(keys["check"], p["check"]) == "wrong":
        yield A.row(family="5+", block=0, kind="cut", header_ok=False, offset=p["end"], error="the password is wrong")
        return
    at, n, cipher = p["end"], 0, Cbc(keys["key"])
    while at < len(data):
        try:
            head, behind = _header(data, at, cipher)
            x = next(A.parse50(head, 0))
        except (ValueError, IndexError, StopIteration) as e:
            yield A.row(family="5+", block=n, kind="cut", header_ok=False, offset=at, error=str(e))
            return
        yield x | {"block": n, "offset": at, "data_offset": behind, "error": "payload is cut short" if behind + x["packed"] > len(data) else None}
        at, n = behind + x["packed"], n + 1
        if x["kind"] == "end":
            return
    yield A.row(family="5+", block=n, kind="cut", header_ok=False, offset=at, error="no end block")


# ------------------------------------------------------------------ format 3
# The main header is open and says by a flag that all later headers are encrypted, each behind its own salt.
FLAG15 = 0x80  # fixed value


@lru_cache(64)
def _cipher30(password: bytes, salt: bytes) -> tuple[Cbc, bytes]:
    """Writers keep one salt for a container, so that a derivation serves all its headers."""
    key, iv = keys30(password, salt)
    return Cbc(key), iv


def seal15(data: bytes, password: bytes, salt: bytes) -> bytes:
    """An open container of formats 3 with its headers behind the main one encrypted under a salt of eight bytes."""
    cipher, iv = _cipher30(password, salt)
    out = [A.MARK15]
    for x in A.parse15(data, len(A.MARK15)):
        header = data[x["offset"] : x["data_offset"]]
        if x["kind"] == "main":
            out.append(A.block15(0x73, x["flags"] | FLAG15, header[7:]))
        else:
            out += [salt, cipher.encrypt(header.ljust(-(-len(header) // 16) * 16, b"\0"), iv), data[x["data_offset"] : x["data_offset"] + x["packed"]]]
    return b"".join(out)


def walk15(data: bytes, password: bytes) -> Iterator[dict]:
    """The blocks of a container of format 3, with the columns of the open walk; a header that the password does not open ends the walk.

    An end block is optional, as in the open walk.
    """
    at, n = len(A.MARK15), 0
    main = next(A.parse15(data, at)) if data.startswith(A.MARK15) else None
    if main is None or main["kind"] != "main" or not main["flags"] & FLAG15:
        yield from A.parse(data)
        return
    yield main
    at, n = main["data_offset"], 1
    while at < len(data):
        start = at
        if at + 24 > len(data):
            yield A.row(family="1.5-4", block=n, kind="cut", header_ok=False, offset=start, error="header is cut short")
            return
        cipher, iv = _cipher30(password, data[at : at + 8])
        first = cipher.decrypt(data[at + 8 : at + 24], iv)
        size = struct.unpack_from("<H", first, 5)[0]
        behind = at + 8 + -(-size // 16) * 16
        error = "the password is wrong or the header is damaged" if size < 7 else "header is cut short" if behind > len(data) else None
        x = None
        if error is None:
            head = (first + cipher.decrypt(data[at + 24 : behind], data[at + 8 : at + 24]))[:size]
            x = next(A.parse15(head, 0))
            error = None if x["header_ok"] else "the password is wrong or the header is damaged"
        if error is not None:
            yield A.row(family="1.5-4", block=n, kind="cut", header_ok=False, offset=start, error=error)
            return
        yield x | {"block": n, "offset": start, "data_offset": behind, "error": "payload is cut short" if behind + x["packed"] > len(data) else None}
        at, n = behind + x["packed"], n + 1
        if x["kind"] == "end":
            return
