"""Byte filters that prepare a payload for compression, and their inverses, in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed value: the window of branch targets.
WINDOW = 1 << 24


def delta_encode(data: bytes, channels: int) -> bytes:
    """Planes of differences: channel by channel, the byte before less the byte."""
    x = np.frombuffer(data, np.uint8)
    out = []
    for c in range(channels):
        plane = x[c::channels]
        out.append(np.diff(plane, prepend=np.zeros(1, np.uint8)).astype(np.uint8) * np.uint8(255))
    return np.concatenate(out).tobytes() if out else b""


def delta_decode(data: bytes, channels: int) -> bytes:
    x = np.frombuffer(data, np.uint8)
    out = np.empty(len(x), np.uint8)
    at = 0
    for c in range(channels):
        n = len(range(c, len(x), channels))
        out[c::channels] = np.cumsum(x[at : at + n].astype(np.int64) * -1).astype(np.uint8)
        at += n
    return out.tobytes()


def _branches(data: bytes, offset: int, e9: bool, decode: bool) -> bytes:
    """Call targets of x86 code: absolute to relative when decoding, the other way when encoding."""
    out = bytearray(data)
    at, n = 0, len(data)
    marks = (0xE8, 0xE9) if e9 else (0xE8,)
    while at + 4 < n:
        if out[at] not in marks:
            at += 1
            continue
        place = (offset + at + 1) % WINDOW
        v = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
        if decode:
            if v < 0 and v + place >= 0:
                out[at + 1 : at + 5] = (v + WINDOW).to_bytes(4, "little", signed=True)
            elif 0 <= v < WINDOW:
                out[at + 1 : at + 5] = (v - place).to_bytes(4, "little", signed=True)
        elif -place <= v < WINDOW - place:
            out[at + 1 : at + 5] = (v + place).to_bytes(4, "little", signed=True)
        elif WINDOW - place <= v < WINDOW:
            out[at + 1 : at + 5] = (v - WINDOW).to_bytes(4, "little", signed=True)
        at += 5
    return bytes(out)


def x86_decode(data: bytes, offset: int = 0, e9: bool = False) -> bytes:
    return _branches(data, offset, e9, True)


def x86_encode(data: bytes, offset: int = 0, e9: bool = False) -> bytes:
    return _branches(data, offset, e9, False)


def _arm(data: bytes, offset: int, sign: int) -> bytes:
    n = len(data) // 4
    words = np.frombuffer(data[: 4 * n], "<u4").astype(np.int64)
    hit = words >> 24 == 0xEB
    place = (offset + 4 * np.arange(n)) // 4
    moved = (words & 0xFFFFFF) + sign * place & 0xFFFFFF
    out = np.where(hit, words & 0xFF000000 | moved, words).astype("<u4")
    return out.tobytes() + data[4 * n :]


def arm_decode(data: bytes, offset: int = 0) -> bytes:
    """Targets of branch-with-link instructions, absolute to relative."""
    return _arm(data, offset, -1)


def arm_encode(data: bytes, offset: int = 0) -> bytes:
    return _arm(data, offset, 1)


# Fixed value: which of the three slots of a bundle hold a branch, by template 16 to 31
SLOTS = (4, 4, 6, 6, 0, 0, 7, 7, 4, 4, 0, 0, 4, 4, 0, 0)


def _itanium(data: bytes, offset: int, sign: int) -> bytes:
    out, place = bytearray(data), offset >> 4
    for at in range(0, len(data) - 21 + 1, 16):
        bundle = int.from_bytes(out[at : at + 16], "little")
        template = (bundle & 31) - 16
        if template >= 0:
            for slot in range(3):
                first = slot * 41 + 5
                if SLOTS[template] >> slot & 1 and bundle >> first + 37 & 15 == 5:
                    target = bundle >> first + 13 & 0xFFFFF
                    bundle ^= (target ^ target + sign * place & 0xFFFFF) << first + 13
            out[at : at + 16] = bundle.to_bytes(16, "little")
        place += 1
    return bytes(out)


def itanium_decode(data: bytes, offset: int = 0) -> bytes:
    """Branch targets of 16-byte bundles, absolute to relative; the last 21 bytes' incomplete bundles stay."""
    return _itanium(data, offset, -1)


def itanium_encode(data: bytes, offset: int = 0) -> bytes:
    return _itanium(data, offset, 1)


def _predicted(left: int, upper: int, corner: int) -> int:
    """Of the three neighbours the nearest to left + upper - corner."""
    p = left + upper - corner
    a, b, c = abs(p - left), abs(p - upper), abs(p - corner)
    return left if a <= b and a <= c else upper if b <= c else corner


def rgb_decode(data: bytes, width: int, red: int = 0) -> bytes:
    """Three planes of differences to the predicted colour of a picture `width` bytes wide; green is added back to red and blue."""
    n, out, at = len(data), bytearray(len(data)), 0
    for channel in range(3):
        left = 0
        for i in range(channel, n, 3):
            upper = i - width
            guess = _predicted(left, out[upper], out[upper - 3]) if upper >= 3 else left
            left = guess - data[at] & 255
            out[i] = left
            at += 1
    for i in range(red, n - 2, 3):
        out[i] = out[i] + out[i + 1] & 255
        out[i + 2] = out[i + 2] + out[i + 1] & 255
    return bytes(out)


def rgb_encode(data: bytes, width: int, red: int = 0) -> bytes:
    plain, out = bytearray(data), bytearray()
    for i in range(red, len(plain) - 2, 3):
        plain[i] = plain[i] - plain[i + 1] & 255
        plain[i + 2] = plain[i + 2] - plain[i + 1] & 255
    for channel in range(3):
        left = 0
        for i in range(channel, len(plain), 3):
            upper = i - width
            guess = _predicted(left, plain[upper], plain[upper - 3]) if upper >= 3 else left
            out.append(guess - plain[i] & 255)
            left = plain[i]
    return bytes(out)
