"""Password ciphers and key derivations of the container formats, and raw AES-CBC from built-in functions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import CRC32

MOST_CHARACTERS = 127


def clamp(password: bytes) -> bytes:
    """The first 127 characters, or bytes where it is not UTF-8."""
    try:
        return password.decode()[:MOST_CHARACTERS].encode()
    except UnicodeDecodeError:
        return password[:MOST_CHARACTERS]


# ------------------------------------------------------------------ format 1.3: an additive stream
def key13(password: bytes) -> tuple[int, int, int]:
    p = np.frombuffer(clamp(password), np.uint8).astype(np.int64)
    c = 0
    for b in p.tolist():
        c = c + b & 255
        c = c << 1 & 255 | c >> 7
    return int(p.sum()) & 255, int(np.bitwise_xor.reduce(p)) if len(p) else 0, c


#: Fixed value: the key of comments.
COMMENT13 = (0, 7, 77)


def stream13(key: tuple[int, int, int], n: int) -> np.ndarray:
    """The n key bytes: both sums of the three-byte register in closed form."""
    i = np.arange(1, n + 1, dtype=np.int64)
    return (key[0] + i * key[1] + key[2] * (i * (i + 1) // 2)) & 255


def crypt13(data: bytes, key: tuple[int, int, int], decrypt: bool) -> bytes:
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    s = stream13(key, len(x))
    return ((x - s if decrypt else x + s) & 255).astype(np.uint8).tobytes()


# ------------------------------------------------------------------ format 1.5: a stream keyed by CRC-32
def _entry(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (CRC32 if b & 1 else 0)
    return b


_ENTRIES = [_entry(b) for b in range(256)]


def crypt15(data: bytes, password: bytes) -> bytes:
    """Exclusive or with the stream of a password, which ends at a NUL; its own inverse."""
    p = clamp(password).split(b"\0")[0]
    crc = zlib.crc32(p) ^ 0xFFFFFFFF
    a, b, c, d = crc & 0xFFFF, crc >> 16, 0, 0
    for x in p:
        t = _ENTRIES[x]
        c ^= x ^ t & 0xFFFF
        d = d + x + (t >> 16) & 0xFFFF
    out = bytearray(data)
    for i in range(len(out)):
        a = a + 0x1234 & 0xFFFF
        t = _ENTRIES[a >> 1 & 255]
        b ^= t & 0xFFFF
        c = c - (t >> 16) & 0xFFFF
        a ^= c
        d = (d >> 1 | d << 15 & 0xFFFF) ^ b
        d = d >> 1 | d << 15 & 0xFFFF
        a ^= d
        out[i] ^= a >> 8
    return bytes(out)


# ------------------------------------------------------------------ format 3: SHA-1 in 2**18 rounds
def keys30(password: bytes, salt: bytes = b"") -> tuple[bytes, bytes]:
    """(key, iv). Only for passwords whose UTF-16 form with the salt stays under 64 bytes; longer ones changed their own buffer in the original."""
    raw = clamp(password).decode().encode("utf-16-le") + salt
    if len(raw) >= 64:
        raise ValueError("password is too long for this derivation")
    h, iv = hashlib.sha1(), bytearray()
    for block in range(16):
        first = block << 14
        h.update(raw + first.to_bytes(3, "little"))
        iv.append(h.copy().digest()[19])
        h.update(b"".join(raw + i.to_bytes(3, "little") for i in range(first + 1, first + (1 << 14))))
    d = h.digest()
    return b"".join(d[i : i + 4][::-1] for i in range(0, 16, 4)), bytes(iv)


# ------------------------------------------------------------------ format 5+: PBKDF2 with three taps
def keys50(password: bytes, salt: bytes, log_rounds: int) -> dict[str, bytes]:
    """key, hash_key and the 8-byte check of a password."""
    if log_rounds > 24:
        raise ValueError("too many rounds")
    p = clamp(password)
    key, hash_key, tap = (hashlib.pbkdf2_hmac("sha256", p, salt, (1 << log_rounds) + more) for more in (0, 16, 32))
    check = bytes(tap[i] ^ tap[i + 8] ^ tap[i + 16] ^ tap[i + 24] for i in range(8))
    return {"key": key, "hash_key": hash_key, "check": check}


def check_record(check: bytes) -> bytes:
    return check + hashlib.sha256(check).digest()[:4]


def verdict(check: bytes, stored: bytes) -> str:
    """correct, wrong, or undetermined for the all-zero record, which holds no check."""
    if stored[:8] == bytes(8):
        return "undetermined"
    return "correct" if stored == check_record(check) else "wrong"


# ------------------------------------------------------------------ AES-CBC without padding, from built-ins
def aes_decrypt_raw(data: Column, key: Column, iv: Column) -> Column:
    """Plain blocks of unpadded AES-CBC: one encrypted padding block is appended, so that the built-in finds valid padding."""
    tail = F.substr(data, F.length(data) - 15, F.lit(16))
    pad = F.substr(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("PKCS"), tail), F.lit(17), F.lit(16))
    return F.aes_decrypt(F.concat(iv, data, pad), key, F.lit("CBC"), F.lit("PKCS"))


def aes_encrypt_raw(data: Column, key: Column, iv: Column) -> Column:
    """Blocks of unpadded AES-CBC: the built-in's iv prefix and padding block are cut off."""
    return F.substr(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.length(data))
