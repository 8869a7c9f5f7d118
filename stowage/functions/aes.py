"""AES in CBC mode on whole blocks, for headers that a block walk decrypts one after the other.

Payloads go through the built-in functions (see ciphers.py); a header's length is known only when the header before it
is read, so headers are decrypted where they are parsed.
"""

from __future__ import annotations

from functools import lru_cache


def _double(a: int) -> int:
    return (a << 1 ^ 0x11B) if a & 0x80 else a << 1


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


@lru_cache(1)
def _boxes() -> tuple[bytes, bytes]:
    """The substitution box and its inverse: the inverse in GF(2**8), then the affine map."""
    power, log = [1] * 256, [0] * 256
    for i in range(1, 255):
        power[i] = _product(power[i - 1], 3)
        log[power[i]] = i
    box = bytearray(256)
    for a in range(256):
        x = power[(255 - log[a]) % 255] if a else 0
        box[a] = x ^ 0x63
        for _ in range(4):
            x = (x << 1 | x >> 7) & 255
            box[a] ^= x
    back = bytearray(256)
    for a, b in enumerate(box):
        back[b] = a
    return bytes(box), bytes(back)


@lru_cache(4)
def _times(by: int) -> bytes:
    return bytes(_product(a, by) for a in range(256))


class Cbc:
    """Key of 16 or 32 bytes."""

    def __init__(self, key: bytes) -> None:
        box, words, n = _boxes()[0], [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4
        round_constant = 1
        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = bytes(box[b] for b in w[1:] + w[:1])
                w = bytes((w[0] ^ round_constant, *w[1:]))
                round_constant = _double(round_constant)
            elif n > 6 and i % n == 4:
                w = bytes(box[b] for b in w)
            words.append(bytes(a ^ b for a, b in zip(w, words[i - n], strict=True)))
        self.keys = [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]

    def _block(self, data: bytes, decode: bool) -> bytes:
        box = _boxes()[decode]
        keys = self.keys[::-1] if decode else self.keys
        # places that rows move to, and the factors that columns are mixed with
        moved = [(i + (-4 if decode else 4) * (i % 4)) % 16 for i in range(16)]
        tables = [_times(k) for k in ((14, 11, 13, 9) if decode else (2, 3, 1, 1))]
        x = bytes(a ^ b for a, b in zip(data, keys[0], strict=True))
        for r, key in enumerate(keys[1:], 1):
            x = bytes(box[x[moved[i]]] for i in range(16))
            if decode:
                x = bytes(a ^ b for a, b in zip(x, key, strict=True))
            if r < len(keys) - 1:
                x = bytes(tables[0][x[i]] ^ tables[1][x[i & 12 | i + 1 & 3]] ^ tables[2][x[i & 12 | i + 2 & 3]] ^ tables[3][x[i & 12 | i + 3 & 3]] for i in range(16))
            if not decode:
                x = bytes(a ^ b for a, b in zip(x, key, strict=True))
        return x

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        out = []
        for i in range(0, len(data), 16):
            iv = self._block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)), False)
            out.append(iv)
        return b"".join(out)

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        out = []
        for i in range(0, len(data), 16):
            out.append(bytes(a ^ b for a, b in zip(self._block(data[i : i + 16], True), iv, strict=True)))
            iv = data[i : i + 16]
        return b"".join(out)
