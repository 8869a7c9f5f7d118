"""Reading and writing the three container layouts: formats 1.3, 1.5 to 4.x and 5+.

Parsers yield flat rows and never raise on damaged input: a header with a wrong check value is marked,
and a container that is cut short keeps the rows before the cut and ends with one that says where.
Writers store payloads as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

# Fixed values of the formats
MARK13, MARK15, MARK50 = b"RE~^", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
SCAN = 8 << 20
TYPES15 = {0x72: "mark", 0x73: "main", 0x74: "file", 0x75: "comment", 0x77: "sub", 0x78: "protect", 0x7A: "newsub", 0x7B: "end"}
TYPES50 = {1: "main", 2: "file", 3: "service", 4: "crypt", 5: "end"}

COLUMNS = "family string, block int, kind string, header_ok boolean, name binary, packed long, unpacked long, method int, host int, attr long, time long, check_value long, flags long, split_before boolean, split_after boolean, is_directory boolean, is_encrypted boolean, is_solid boolean, offset long, data_offset long, extras array<struct<type:long,data:binary>>, error string"
FIELDS = [c.split()[0] for c in COLUMNS.split(", ")]


def row(**kw) -> dict:
    return {k: kw.get(k) for k in FIELDS}


# ------------------------------------------------------------------ variable-length numbers
def vint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); ValueError where it is cut short, too long or passes 64 bits."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise ValueError("number is cut short")
        b = data[at + k]
        value |= (b & 127) << 7 * k
        if b < 128:
            if value >> 64:
                raise ValueError("number passes 64 bits")
            return value, at + k + 1
    raise ValueError("number is too long")


# ------------------------------------------------------------------ signatures
def find_signature(data: bytes, most: int = SCAN) -> tuple[str, int, int] | None:
    """(family, offset, length): the first strong signature up to `most`; the 1.3 one only where there is no strong one."""
    found = [(i, name, len(mark)) for name, mark in (("5+", MARK50), ("1.5-4", MARK15)) if 0 <= (i := data.find(mark, 0, most + len(mark)))]
    if found:
        i, name, n = min(found)
        return name, i, n
    i = data.find(MARK13, 0, most + 4)
    return ("1.3", i, 4) if i >= 0 else None


# ------------------------------------------------------------------ format 5+
def block50(kind: int, flags: int, body: bytes, extra: bytes = b"", data: bytes | None = None) -> bytes:
    flags |= (1 if extra else 0) | (2 if data is not None else 0)
    h = vint(kind) + vint(flags) + (vint(len(extra)) if extra else b"") + (vint(len(data)) if data is not None else b"") + body + extra
    h = vint(len(h)) + h
    return struct.pack("<I", zlib.crc32(h)) + h + (data or b"")


def extra50(kind: int, data: bytes) -> bytes:
    body = vint(kind) + data
    return vint(len(body)) + body


def write50(members: list[dict], volume: int | None = None, more: bool = False, solid: bool = False, comment: bytes | None = None, locked: bool = False, metadata: bytes | None = None) -> bytes:
    """A container of stored members: name, payload and optionally mtime, attr, host, directory, hash, link (type, flags, target), version, encryption (its record), split_before, split_after, unpacked, crc."""
    flags = (1 if volume is not None else 0) | (2 if volume else 0) | (4 if solid else 0) | (16 if locked else 0)
    out = [MARK50, block50(1, 0, vint(flags) + (vint(volume) if volume else b""), extra50(2, metadata) if metadata else b"")]
    if comment is not None:
        body = vint(4) + vint(len(comment)) + vint(0) + struct.pack("<I", zlib.crc32(comment)) + vint(0) + vint(0) + vint(3) + b"CMT"
        out.append(block50(3, 0, body, data=comment))
    for m in members:
        data = m.get("payload") or b""
        directory, mtime = m.get("directory", False), m.get("mtime")
        file_flags = (1 if directory else 0) | (2 if mtime is not None else 0) | (0 if directory else 4)
        crc = b"" if directory else struct.pack("<I", m.get("crc", zlib.crc32(data)))
        body = vint(file_flags) + vint(m.get("unpacked", len(data))) + vint(m.get("attr", 0o100644)) + (struct.pack("<I", mtime) if mtime is not None else b"") + crc + vint(0) + vint(m.get("host", 1)) + vint(len(m["name"])) + m["name"]
        extra = extra50(1, m["encryption"]) if m.get("encryption") else b""
        if m.get("hash"):
            extra += extra50(2, vint(0) + m["hash"])
        if m.get("version"):
            extra += extra50(4, vint(0) + vint(m["version"]))
        if m.get("link"):
            kind, link_flags, target = m["link"]
            extra += extra50(5, vint(kind) + vint(link_flags) + vint(len(target)) + target)
        out.append(block50(2, (8 if m.get("split_before") else 0) | (16 if m.get("split_after") else 0), body, extra, data))
    out.append(block50(5, 0, vint(1 if more else 0)))
    return b"".join(out)


def _extras(data: bytes) -> list[dict]:
    found, at = [], 0
    while at < len(data):
        size, body = read_vint(data, at)
        kind, start = read_vint(data, body)
        found.append({"type": kind, "data": data[start : body + size]})
        at = body + size
    return found


def parse50(data: bytes, at: int) -> Iterator[dict]:
    n = 0
    while at < len(data):
        start = at
        try:
            if at + 5 > len(data):
                raise ValueError("header is cut short")
            crc = struct.unpack_from("<I", data, at)[0]
            size, body = read_vint(data, at + 4)
            end = body + size
            if end > len(data) or not size:
                raise ValueError("header is cut short")
            header = data[:end]
            ok = zlib.crc32(header[at + 4 : end]) == crc
            kind, at = read_vint(header, body)
            flags, at = read_vint(header, at)
            extra_size = data_size = 0
            if flags & 1:
                extra_size, at = read_vint(header, at)
            if flags & 2:
                data_size, at = read_vint(header, at)
            x = row(family="5+", block=n, kind=TYPES50.get(kind, "unknown"), header_ok=ok, packed=data_size, flags=flags, offset=start, data_offset=end, split_before=bool(flags & 8), split_after=bool(flags & 16), extras=_extras(header[end - extra_size : end]) if flags & 1 else [])
            if kind in (2, 3):
                file_flags, at = read_vint(header, at)
                x["unpacked"], at = read_vint(header, at)
                x["attr"], at = read_vint(header, at)
                if file_flags & 2:
                    x["time"], at = struct.unpack_from("<I", header, at)[0], at + 4
                if file_flags & 4:
                    x["check_value"], at = struct.unpack_from("<I", header, at)[0], at + 4
                info, at = read_vint(header, at)
                host, at = read_vint(header, at)
                length, at = read_vint(header, at)
                name = header[at : at + length]
                for e in x["extras"]:
                    if e["type"] == 4 and kind == 2:  # a version renames the member
                        _, k = read_vint(e["data"], 0)
                        v, _ = read_vint(e["data"], k)
                        name += b";%d" % v if v else b""
                x |= {"name": name, "method": info >> 7 & 7, "host": host, "is_solid": bool(info & 64), "is_directory": bool(file_flags & 1), "is_encrypted": any(e["type"] == 1 for e in x["extras"])}
            elif kind in (1, 5):
                x["attr"], at = read_vint(header, at)
                if kind == 1 and x["attr"] & 2:
                    x["time"], at = read_vint(header, at)  # the volume's number
        except (ValueError, struct.error, IndexError) as e:
            yield row(family="5+", block=n, kind="cut", header_ok=False, offset=start, error=str(e))
            return
        if end + data_size > len(data):
            x["error"] = "payload is cut short"
        yield x
        at, n = end + data_size, n + 1
        if kind == 5:
            return
    yield row(family="5+", block=n, kind="cut", header_ok=False, offset=at, error="no end block")


# ------------------------------------------------------------------ formats 1.5 to 4.x
def block15(kind: int, flags: int, body: bytes, checked: int | None = None) -> bytes:
    """The check value covers the first `checked` bytes, or all."""
    h = struct.pack("<BHH", kind, flags, len(body) + 7) + body
    return struct.pack("<H", zlib.crc32(h[: None if checked is None else checked - 2]) & 0xFFFF) + h


def comment15(text: bytes, packed: bytes | None = None, version: int = 15) -> bytes:
    """A comment block as it stands inside a main or file header: stored, or `packed` by the codec of a version."""
    body = packed if packed is not None else text
    return block15(0x75, 0, struct.pack("<HBBH", len(text), version, 0x33 if packed is not None else 0x30, zlib.crc32(text) & 0xFFFF) + body, 13)


def nested15(header: bytes, at: int) -> dict | None:
    """unpacked, version, method, check, data and header_ok of the comment block at a place in a header; None where there is none that fits."""
    if at + 13 > len(header):
        return None
    crc, kind, _, size, unpacked, version, method, check = struct.unpack_from("<HBHHHBBH", header, at)
    if kind != 0x75 or size < 13 or at + size > len(header):
        return None
    return {"unpacked": unpacked, "version": version, "method": method - 0x30, "check": check, "data": header[at + 13 : at + size], "header_ok": zlib.crc32(header[at + 2 : at + 13]) & 0xFFFF == crc}


def write15(members: list[dict], main_flags: int = 0, end_flags: int = 0, number: int | None = None, comment: bytes | None = None) -> bytes:
    """`comment`, and `comment` of a member, are comment blocks to stand inside the headers; a header's check value leaves them out."""
    out = [MARK15, block15(0x73, main_flags | (2 if comment else 0), bytes(6) + (comment or b""), 13 if comment else None)]
    for m in members:
        data = m.get("payload") or b""
        flags = 0x8000 | (1 if m.get("split_before") else 0) | (2 if m.get("split_after") else 0) | (8 if m.get("comment") else 0) | (0xE0 if m.get("directory") else 0)
        body = struct.pack("<IIBIIBBHI", len(data), m.get("unpacked", len(data)), m.get("host", 3), m.get("crc", zlib.crc32(data)), m.get("time", 0), 29, 0x30, len(m["name"]), m.get("attr", 0o100644)) + m["name"]
        nested = m.get("comment") or b""
        out += [block15(0x74, flags, body + nested, len(body) + 7 if nested else None), data]
    out.append(block15(0x7B, end_flags | (8 if number is not None else 0), struct.pack("<H", number) if number is not None else b""))
    return b"".join(out)


def named15(header: bytes) -> int:
    """Where a file header's fixed fields, name and salt end."""
    flags, length = struct.unpack_from("<H", header, 3)[0], struct.unpack_from("<H", header, 26)[0]
    return min(len(header), 32 + (8 if flags & 0x100 else 0) + length + (8 if flags & 0x400 else 0))


def comments15(data: bytes) -> Iterator[tuple[int | None, dict]]:
    """(member's number, comment block) of the comments inside headers; the container's own has no number."""
    found = find_signature(data)
    if found is None or found[0] != "1.5-4":
        return
    n = 0
    for x in parse15(data, found[1] + found[2]):
        if x["kind"] not in ("main", "file"):
            continue
        h = data[x["offset"] : x["data_offset"]]
        main = x["kind"] == "main"
        if x["flags"] & (2 if main else 8) and (c := nested15(h, 13 if main else named15(h))) is not None:
            yield None if main else n, c
        n += not main


def parse15(data: bytes, at: int) -> Iterator[dict]:
    """An end block is optional here: versions before 3 wrote none."""
    n = 0
    if at >= len(data):
        yield row(family="1.5-4", block=0, kind="cut", header_ok=False, offset=at, error="no main block")
    while at < len(data):
        start = at
        if at + 7 > len(data):
            yield row(family="1.5-4", block=n, kind="cut", header_ok=False, offset=start, error="header is cut short")
            return
        crc, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        if size < 7 or at + size > len(data):
            yield row(family="1.5-4", block=n, kind="cut", header_ok=False, offset=start, error="header size is wrong" if size < 7 else "header is cut short")
            return
        h = data[at : at + size]
        packed = struct.unpack_from("<I", h, 7)[0] if flags & 0x8000 and size >= 11 else 0
        covered = size  # a comment inside a header is left out of its check value
        if kind == 0x73 and flags & 2:
            covered = 13
        elif kind == 0x74 and flags & 8 and size >= 32:
            covered = named15(h)
        ok = kind == 0x72 or zlib.crc32(h[2:covered]) & 0xFFFF == crc
        x = row(family="1.5-4", block=n, kind=TYPES15.get(kind, "unknown"), header_ok=ok, flags=flags, offset=start, data_offset=at + size, packed=packed, extras=[])
        try:
            if kind in (0x74, 0x7A):
                _, unpacked, host, check, time, _, method, length, attr = struct.unpack_from("<IIBIIBBHI", h, 7)
                at_name = 32
                if flags & 0x100:
                    high_packed, high_unpacked = struct.unpack_from("<II", h, 32)
                    packed, unpacked, at_name = packed | high_packed << 32, unpacked | high_unpacked << 32, 40
                x |= {"packed": packed, "unpacked": unpacked, "host": host, "check_value": check, "time": time, "method": method - 0x30, "attr": attr, "name": legacy_name(h[at_name : at_name + length], bool(flags & 0x200)), "split_before": bool(flags & 1), "split_after": bool(flags & 2), "is_encrypted": bool(flags & 4), "is_solid": bool(flags & 16), "is_directory": flags & 0xE0 == 0xE0}
            elif kind == 0x7B and flags & 8:
                x["time"] = struct.unpack_from("<H", h, 11 if flags & 2 else 7)[0]  # the volume's number
        except struct.error:
            x["error"] = "header is cut short"
        if at + size + packed > len(data):
            x["error"] = "payload is cut short"
        yield x
        at, n = at + size + packed, n + 1
        if kind == 0x7B:
            return


def protect15(rec_sectors: int, blocks: int) -> bytes:
    """A recovery record's header of version 2: sectors of parity and blocks covered."""
    return block15(0x78, 0, struct.pack("<IBHI", 0, 1, rec_sectors, blocks) + b"Protect!")


def read_protect(header: bytes) -> dict | None:
    """rec_sectors, blocks and the data that follows (tags and parity); null without the mark."""
    if len(header) < 26 or header[18:26] != b"Protect!":
        return None
    sectors, blocks = struct.unpack_from("<HI", header, 12)
    return {"rec_sectors": sectors, "blocks": blocks, "data_size": 2 * blocks + 512 * sectors}


def legacy_name(raw: bytes, unicode: bool) -> bytes:
    """A name with a packed Unicode form (two-bit commands over the fallback), as UTF-8; other names and short forms come back as they are."""
    zero = raw.find(b"\0")
    if not unicode or zero < 0:
        return raw
    base, code = raw[:zero], raw[zero + 1 :]
    if not code:
        return raw
    high, at, out = code[0] << 8, 1, []
    bits = left = 0
    try:
        while at < len(code):
            if not left:
                bits, left, at = code[at], 4, at + 1
                if at >= len(code):
                    break
            op = bits >> 6
            bits, left = bits << 2 & 255, left - 1
            if op == 0:
                out.append(code[at])
                at += 1
            elif op == 1:
                out.append(high | code[at])
                at += 1
            elif op == 2:
                out.append(code[at] | code[at + 1] << 8)
                at += 2
            else:
                n = code[at]
                at += 1
                shift = None
                if n & 128:
                    shift, at = code[at], at + 1
                for _ in range((n & 127) + 2):
                    c = base[len(out)]
                    out.append(c if shift is None else high | (c + shift & 255))
    except IndexError:
        return raw
    return b"".join(struct.pack("<H", c) for c in out).decode("utf-16-le", "replace").encode()


# ------------------------------------------------------------------ format 1.3
def checksum13(data: bytes) -> int:
    v = 0
    for b in data:
        v = v + b & 0xFFFF
        v = (v << 1 | v >> 15) & 0xFFFF
    return v


def write13(members: list[dict], flags: int = 0x80) -> bytes:
    out = [MARK13 + struct.pack("<HB", 7, flags)]
    for m in members:
        data = m.get("payload") or b""
        own = (1 if m.get("split_before") else 0) | (2 if m.get("split_after") else 0)
        out += [struct.pack("<IIHHIBBBBB", len(data), m.get("unpacked", len(data)), m.get("crc", checksum13(data)), 21 + len(m["name"]), m.get("time", 0), m.get("attr", 32) & 255, own, 2, len(m["name"]), 0) + m["name"], data]
    return b"".join(out)


def parse13(data: bytes, at: int) -> Iterator[dict]:
    if at + 7 > len(data):
        yield row(family="1.3", block=0, kind="cut", header_ok=False, offset=at, error="header is cut short")
        return
    size, main = struct.unpack_from("<HB", data, at + 4)
    yield row(family="1.3", block=0, kind="main", header_ok=True, flags=main, offset=at, data_offset=at + size, packed=0, extras=[])
    at, n = at + size, 1
    while at + 21 <= len(data):
        packed, unpacked, check, head, time, attr, flags, _, length, method = struct.unpack_from("<IIHHIBBBBB", data, at)
        if head < 21 or at + head > len(data):
            yield row(family="1.3", block=n, kind="cut", header_ok=False, offset=at, error="header is cut short")
            return
        x = row(family="1.3", block=n, kind="file", header_ok=True, name=data[at + 21 : at + 21 + length], packed=packed, unpacked=unpacked, method=method, host=0, attr=attr, time=time, check_value=check, flags=flags, split_before=bool(flags & 1), split_after=bool(flags & 2), is_directory=bool(attr & 16), is_encrypted=bool(flags & 4), is_solid=bool(main & 8), offset=at, data_offset=at + head, extras=[])
        if at + head + packed > len(data):
            x["error"] = "payload is cut short"
        yield x
        at, n = at + head + packed, n + 1


def parse(data: bytes) -> Iterator[dict]:
    """Rows of the blocks of a container, whatever its family; one error row for bytes without a signature."""
    found = find_signature(data)
    if found is None:
        yield row(kind="none", header_ok=False, error="no signature")
        return
    family, at, length = found
    if family == "5+":
        yield from parse50(data, at + length)
    elif family == "1.5-4":
        yield from parse15(data, at + length)
    else:
        yield from parse13(data, at)


def payload_ok(x: dict, data: bytes) -> bool:
    """Integrity of a stored member: the strong hash where present, else the family's checksum."""
    from .checksums import blake2sp

    for e in x["extras"] or ():
        if e["type"] == 2:
            return blake2sp(data) == e["data"][1:]
    if x["check_value"] is None:
        return True
    return (checksum13(data) if x["family"] == "1.3" else zlib.crc32(data)) == x["check_value"]


# ------------------------------------------------------------------ recovery volumes of format 5+
REV = b"Rar!\x1aRev"


def write_rev(number: int, data_sizes: list[tuple[int, int]], parity_count: int, payload: bytes) -> bytes:
    body = struct.pack("<BHHHI", 1, len(data_sizes), parity_count, number, zlib.crc32(payload)) + b"".join(struct.pack("<QI", s, c) for s, c in data_sizes)
    tail = struct.pack("<I", len(body)) + body
    return REV + struct.pack("<I", zlib.crc32(tail)) + tail + payload


def parse_rev(data: bytes) -> dict:
    crc, size = struct.unpack_from("<II", data, 8)
    version, n, parity, number, payload_crc = struct.unpack_from("<BHHHI", data, 16)
    shards = [struct.unpack_from("<QI", data, 27 + 12 * i) for i in range(n)]
    payload = data[16 + size :]
    return {"ok": data[:8] == REV and version == 1 and zlib.crc32(data[12 : 16 + size]) == crc and zlib.crc32(payload) == payload_crc, "data_count": n, "parity_count": parity, "number": number, "shards": shards, "payload": payload}
