"""Erasure codes over GF(2**16) and GF(2**8) in numpy: parity shards and reconstruction."""

from __future__ import annotations

import numpy as np


class Field:
    """GF(2**bits) with logarithm tables made from its polynomial."""

    def __init__(self, bits: int, polynomial: int) -> None:
        self.order = (1 << bits) - 1
        self.dtype = np.dtype("<u2") if bits == 16 else np.dtype(np.uint8)
        self.exp = np.zeros(2 * self.order + 1, np.int64)
        self.log = np.zeros(self.order + 1, np.int64)
        x = 1
        for i in range(self.order):
            self.exp[i] = x
            self.log[x] = i
            x <<= 1
            if x > self.order:
                x ^= polynomial
        self.exp[self.order : 2 * self.order] = self.exp[: self.order]

    def multiply(self, a, b):
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        return np.where((a == 0) | (b == 0), 0, self.exp[self.log[a] + self.log[b]])

    def inverse(self, a: int) -> int:
        if a == 0:
            raise ZeroDivisionError("zero has no inverse")
        return int(self.exp[self.order - self.log[a]])

    def divide(self, a: int, b: int) -> int:
        return int(self.multiply(a, self.inverse(b)))

    def product(self, matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """matrix times rows; row by row, so that memory stays near that of the result."""
        out = np.zeros((matrix.shape[0], rows.shape[1]), np.int64)
        for i in range(matrix.shape[0]):
            for j in range(matrix.shape[1]):
                if matrix[i, j]:
                    out[i] ^= self.multiply(matrix[i, j], rows[j])
        return out

    def solve(self, matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
        a, b, n = matrix.astype(np.int64).copy(), rows.astype(np.int64).copy(), len(matrix)
        for i in range(n):
            pivot = i + int(np.argmax(a[i:, i] != 0))
            a[[i, pivot]], b[[i, pivot]] = a[[pivot, i]], b[[pivot, i]]
            f = self.inverse(int(a[i, i]))
            a[i], b[i] = self.multiply(a[i], f), self.multiply(b[i], f)
            for k in range(n):
                if k != i and a[k, i]:
                    f = int(a[k, i])
                    a[k] ^= self.multiply(a[i], f)
                    b[k] ^= self.multiply(b[i], f)
        return b


#: The fields' polynomials.
GF16, GF8 = Field(16, 0x1100B), Field(8, 0x11D)


def encoder_matrix(data: int, parity: int, field: Field = GF16) -> np.ndarray:
    """Cell (i, j) is the inverse of (i + data) xor j."""
    return np.array([[field.inverse((i + data) ^ j) for j in range(data)] for i in range(parity)], np.int64).reshape(parity, data)


def _rows(shards: list[bytes], field: Field) -> np.ndarray:
    return np.stack([np.frombuffer(s, field.dtype).astype(np.int64) for s in shards])


def encode(data: list[bytes], parity: int, field: Field = GF16) -> list[bytes]:
    """Parity shards of data shards of one (even) length."""
    out = field.product(encoder_matrix(len(data), parity, field), _rows(data, field))
    return [r.astype(field.dtype).tobytes() for r in out]


def reconstruct(data: list[bytes | None], parity: list[tuple[int, bytes]], field: Field = GF16) -> list[bytes]:
    """Data shards with the missing ones solved from as many parity shards (index, bytes); ValueError where there are too few."""
    lost = [i for i, d in enumerate(data) if d is None]
    if not lost:
        return list(data)
    if len(parity) < len(lost):
        raise ValueError("not enough parity shards")
    use = parity[: len(lost)]
    full = encoder_matrix(len(data), max(k for k, _ in use) + 1, field)[[k for k, _ in use]]
    here = [i for i, d in enumerate(data) if d is not None]
    rest = _rows([b for _, b in use], field)
    if here:
        rest ^= field.product(full[:, here], _rows([data[i] for i in here], field))
    solved = field.solve(full[:, lost], rest)
    out = list(data)
    for i, r in zip(lost, solved, strict=True):
        out[i] = r.astype(field.dtype).tobytes()
    return out
