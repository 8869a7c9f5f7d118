"""Stored names: legacy code pages, the marked form of format 5+, and packed Unicode."""

from __future__ import annotations

CODECS = {"cp437": "cp437", "cp850": "cp850", "cp852": "cp852", "cp866": "cp866", "windows-1251": "cp1251", "windows-1252": "cp1252", "utf-8": "utf-8"}
MARK = "￾"


def decode_legacy(name: bytes, encoding: str) -> str | None:
    """Strict: null where a byte is undefined in the code page."""
    try:
        return name.decode(CODECS[encoding])
    except UnicodeDecodeError:
        return None


def encode_marked(name: bytes) -> bytes:
    """Names that are not UTF-8, or hold the mark itself: a mark, and high bytes as U+E080 to U+E0FF."""
    try:
        if MARK not in name.decode():
            return name
    except UnicodeDecodeError:
        pass
    return (MARK + "".join(chr(b if b < 128 else 0xE000 + b) for b in name)).encode()


def decode_marked(name: bytes) -> bytes:
    try:
        text = name.decode()
    except UnicodeDecodeError:
        return name
    if MARK not in text:
        return name
    return b"".join(b"" if c == MARK else bytes((ord(c) - 0xE000,)) if "" <= c <= "" else c.encode() for c in text)


def encode_packed(name: str) -> bytes:
    """An ASCII fallback, NUL, a high byte of zero, and every UTF-16 unit as a full command."""
    units = name.encode("utf-16-le")
    out = bytearray("".join(c if c.isascii() else "_" for c in name).encode() + b"\0\0")
    for i in range(0, len(units), 8):
        out += b"\xaa" + units[i : i + 8]
    return bytes(out)
