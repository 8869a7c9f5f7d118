"""Where bytes stood before: chains of places by their next four bytes, and search trees of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

KEY = 4


def common(data: bytes, a: int, b: int, known: int = 0) -> int:
    """How many bytes from a and b on are equal; the later one is b."""
    n = len(data)
    while b + known < n and data[a + known] == data[b + known]:
        known += 1
    return known


class Chains:
    """Each place knows the one before it with the same key; `depth` places are compared, None: all."""

    def __init__(self, data: bytes, window: int = 1 << 17, depth: int | None = 32) -> None:
        self.data, self.window, self.depth = data, window, depth
        self.head: dict[bytes, int] = {}
        self.before = [-1] * len(data)

    def add(self, i: int) -> None:
        key = self.data[i : i + KEY]
        if len(key) == KEY:
            self.before[i] = self.head.get(key, -1)
            self.head[key] = i

    def longest(self, i: int) -> tuple[int, int] | None:
        """(length, distance) of the longest match, of equal ones the nearest; i itself is not added yet."""
        j, best, tries = self.head.get(self.data[i : i + KEY], -1), None, 0
        while 0 <= j and i - j <= self.window and (self.depth is None or tries < self.depth):
            length = common(self.data, j, i, KEY)
            if best is None or length > best[0]:
                best = (length, i - j)
            j, tries = self.before[j], tries + 1
        return best

    def tokens(self, most: int) -> Iterator[int | tuple[int, int]]:
        i = 0
        while i < len(self.data):
            m = self.longest(i)
            n = 1 if m is None else min(m[0], most)
            yield self.data[i] if m is None else (n, m[1])
            for k in range(i, i + n):
                self.add(k)
            i += n


class Tree:
    """For each key a binary tree of suffixes in byte order, the newest at its root: one walk finds every longer match and makes the new root."""

    def __init__(self, data: bytes, window: int = 1 << 17, depth: int | None = 64) -> None:
        self.data, self.window, self.depth = data, window, depth
        self.root: dict[bytes, int] = {}
        self.sons = [[-1] * len(data), [-1] * len(data)]  # lower, higher

    def place(self, i: int) -> list[tuple[int, int]]:
        """(length, distance) of matches at i, each longer than the one before; places must come in order."""
        data, sons = self.data, self.sons
        key = data[i : i + KEY]
        if len(key) < KEY:
            return []
        j, self.root[key] = self.root.get(key, -1), i
        out: list[tuple[int, int]] = []
        ends, known, best, tries = [i, i], [0, 0], KEY - 1, 0  # where the next lower and higher suffix will hang, and what they share with i
        sides = [0, 1]
        while 0 <= j and i - j <= self.window and (self.depth is None or tries < self.depth):
            tries += 1
            k = common(data, j, i, min(known))
            if k > best:
                best = k
                out.append((k, i - j))
            if i + k == len(data):  # i is a prefix of j: it takes j's place
                for side in (0, 1):
                    sons[sides[side]][ends[side]] = sons[side][j]
                return out
            side = 0 if data[j + k] < data[i + k] else 1
            sons[sides[side]][ends[side]] = j
            ends[side], sides[side], known[side] = j, 1 - side, k
            j = sons[1 - side][j]
        for side in (0, 1):
            sons[sides[side]][ends[side]] = -1
        return out

    def all(self) -> Iterator[list[tuple[int, int]]]:
        for i in range(len(self.data)):
            yield self.place(i)


def rebuilt(tokens) -> bytes:
    out = bytearray()
    for t in tokens:
        if isinstance(t, int):
            out.append(t)
            continue
        for _ in range(t[0]):
            out.append(out[-t[1]])
    return bytes(out)
