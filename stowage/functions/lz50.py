"""The compressed payloads of format 5+: blocks of Huffman-coded literals, matches and filters.

The decoder keeps its history, old distances and tables, so that a solid chain is decoded by one
object, member after member. The encoder finds matches with a hash of four bytes and writes blocks of its own
design; it aims at correct round trips, not at another packer's bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

from .filters import arm_decode, arm_encode, delta_decode, delta_encode, x86_decode, x86_encode

# Fixed values of the format: sizes of the code tables and of the code that stores their lengths
LITERALS, DISTANCES, LOWS, LENGTHS, CODES = 306, 64, 16, 44, 20
TABLES = (LITERALS, DISTANCES, LOWS, LENGTHS)
FILTER, REPEAT, OLD, MATCH = 256, 257, 258, 262
MOST_LENGTH, MOST_FILTER = 0x1001, 1 << 22


class Bits:
    """Most significant bit first."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.value, self.total, self.at = int.from_bytes(data, "big"), len(data) * 8, 0
        self.end = bits

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("block is cut short")
        out = self.value >> (self.total - self.at - n) & ((1 << n) - 1)
        self.at += n
        return out

    def peek15(self) -> int:
        shift = self.total - self.at - 15
        return (self.value >> shift if shift >= 0 else self.value << -shift) & 32767


class Window(Bits):
    """Bits over a large block: a sliding number of a few bytes instead of one of the whole block."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.data, self.end, self.at = data + b"\0\0\0\0", bits, 0

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("block is cut short")
        first, skip = self.at >> 3, self.at & 7
        size = (skip + n + 7) >> 3
        out = int.from_bytes(self.data[first : first + size], "big") >> (size * 8 - skip - n) & ((1 << n) - 1)
        self.at += n
        return out

    def peek15(self) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 3].ljust(3, b"\0"), "big") >> (9 - (self.at & 7)) & 32767


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """Look-up of 15 bits -> (symbol, length) for code lengths up to 15, codes in order of length and symbol; length 0 marks unused codes."""
    table: list[tuple[int, int]] = [(0, 0)] * 32768
    at = 0
    for length in range(1, 16):
        for symbol, n in enumerate(lengths):
            if n == length:
                size = 1 << (15 - length)
                if at + size > 32768:
                    raise ValueError("codes overlap")
                table[at : at + size] = [(symbol, length)] * size
                at += size
    return table


def symbol(bits: Bits, table: list[tuple[int, int]]) -> int:
    s, n = table[bits.peek15()]
    if not n or bits.at + n > bits.end:
        raise ValueError("code is not in the table")
    bits.at += n
    return s


def read_tables(bits: Bits) -> list[list[int]]:
    lengths: list[int] = []
    while len(lengths) < CODES:
        n = bits.take(4)
        if n == 15 and (zeros := bits.take(4)):
            lengths += [0] * (zeros + 2)
        else:
            lengths.append(n)
    table, out = canonical(lengths[:CODES]), []
    while len(out) < sum(TABLES):
        s = symbol(bits, table)
        if s < 16:
            out.append(s)
            continue
        n = bits.take(3) + 3 if s in (16, 18) else bits.take(7) + 11
        if s < 18 and not out:
            raise ValueError("nothing to repeat")
        out += [out[-1] if s < 18 else 0] * n
    found, at = [], 0
    for size in TABLES:
        found.append(out[at : at + size])
        at += size
    return found


def parse_block(data: bytes, at: int) -> tuple[int, int, int, bool, bool]:
    """(first byte, past byte, bits, is last, has tables) of the block at a place."""
    flags = data[at]
    n = (flags >> 3 & 3) + 1
    if n == 4 or at + 2 + n > len(data):
        raise ValueError("block header is wrong")
    check = 0x5A ^ flags
    for b in data[at + 2 : at + 2 + n]:
        check ^= b
    if check != data[at + 1]:
        raise ValueError("block header has a wrong check value")
    size, first = int.from_bytes(data[at + 2 : at + 2 + n], "little"), at + 2 + n
    if first + size > len(data):
        raise ValueError("block is cut short")
    return first, first + size, max(0, size - 1) * 8 + (flags & 7) + 1, bool(flags & 0x40), bool(flags & 0x80)


class Decoder:
    """Decodes the members of a chain in order."""

    def __init__(self) -> None:
        self.history = bytearray()
        self.old, self.length = [0, 0, 0, 0], 0
        self.tables: list | None = None

    def _slot(self, bits: Bits, slot: int) -> int:
        if slot < 8:
            return 2 + slot
        extra = slot // 4 - 1
        return 2 + ((4 | slot & 3) << extra) + bits.take(extra)

    def decode(self, data: bytes, size: int) -> bytes:
        out, start = self.history, len(self.history)
        filters: list[tuple[int, int, int, int]] = []
        at, last = 0, False
        while not last and (at < len(data) or not data):
            first, end, n, last, fresh = parse_block(data, at)
            bits = Window(data[first:end], n)
            if fresh:
                self.tables = [canonical(x) for x in read_tables(bits)]
            if self.tables is None:
                raise ValueError("block without tables")
            main, far, low, short = self.tables
            while bits.at < bits.end:
                s = symbol(bits, main)
                if s < 256:
                    out.append(s)
                    continue
                if s == FILTER:
                    number = lambda: int.from_bytes(bytes(bits.take(8) for _ in range(bits.take(2) + 1)), "little")  # noqa: B023, E731
                    begin, length, kind = number(), number(), bits.take(3)
                    if length > MOST_FILTER or kind > 3:
                        raise ValueError("filter is not known")
                    filters.append((len(out) - start + begin, length, kind, bits.take(5) + 1 if kind == 0 else 0))
                    continue
                if s == REPEAT:
                    if not self.length:
                        continue
                    length, distance = self.length, self.old[0]
                elif s < MATCH:
                    distance = self.old.pop(s - OLD)
                    self.old.insert(0, distance)
                    length = self._slot(bits, symbol(bits, short))
                else:
                    length = self._slot(bits, s - MATCH)
                    slot = symbol(bits, far)
                    if slot < 4:
                        distance = slot + 1
                    else:
                        extra = slot // 2 - 1
                        distance = ((2 | slot & 1) << extra) + 1
                        if extra >= 4:
                            distance += (bits.take(extra - 4) << 4 if extra > 4 else 0) + symbol(bits, low)
                        else:
                            distance += bits.take(extra)
                    length += (distance > 0x100) + (distance > 0x2000) + (distance > 0x40000)
                    self.old = [distance, *self.old[:3]]
                self.length = length
                if not 0 < distance <= len(out):
                    raise ValueError("match reaches before the start")
                from_ = len(out) - distance
                if distance >= length:
                    out += out[from_ : from_ + length]
                else:
                    out += (out[from_:] * (length // distance + 1))[:length]
            at = end
        if len(out) - start < size:
            raise ValueError("payload is too short")
        del out[start + size :]
        plain = bytearray(out[start:])
        for begin, length, kind, channels in filters:
            piece = bytes(plain[begin : begin + length])
            plain[begin : begin + length] = delta_decode(piece, channels) if kind == 0 else arm_decode(piece, begin) if kind == 3 else x86_decode(piece, begin, kind == 2)
        return bytes(plain)


# ------------------------------------------------------------------ encoding
def code_lengths(frequencies: list[int], most: int = 15) -> list[int]:
    """Huffman code lengths of at most `most` bits: frequencies are flattened until they fit."""
    used = [(f, s) for s, f in enumerate(frequencies) if f]
    if len(used) == 1:
        used.append((1, 0 if used[0][1] else 1))
    while True:
        heap = [(f, s, (s,)) for f, s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for _, s in used), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if not depth or max(depth.values()) <= most:
            return [depth.get(s, 0) for s in range(len(frequencies))]
        used = [(f // 2 + 1, s) for f, s in used]


def codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    out, code = {}, 0
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = (code, n)
                code += 1
        code <<= 1
    return out


def _slot_of(value: int) -> tuple[int, int, int]:
    """(slot, extra bits, their value) of a length of at least 2."""
    v = value - 2
    if v < 8:
        return v, 0, 0
    extra = v.bit_length() - 3
    return (extra + 1) * 4 + (v >> extra & 3), extra, v & ((1 << extra) - 1)


def _distance_slot(distance: int) -> tuple[int, int, int]:
    d = distance - 1
    if d < 4:
        return d, 0, 0
    extra = d.bit_length() - 2
    return (extra + 1) * 2 + (d >> extra & 1), extra, d & ((1 << extra) - 1)


def tokens(data: bytes, window: int = 1 << 17, most: int = MOST_LENGTH - 3) -> list[int | tuple[int, int]]:
    """Literals and (length, distance) by the last place of each four bytes."""
    out: list[int | tuple[int, int]] = []
    seen: dict[bytes, int] = {}
    i, n = 0, len(data)
    while i < n:
        key = data[i : i + 4]
        j = seen.get(key, -1) if len(key) == 4 else -1
        seen[key] = i
        if j >= 0 and i - j <= window:
            length = 4
            while length < most and i + length < n and data[j + length] == data[i + length]:
                length += 1
            out.append((length, i - j))
            for k in range(i + 1, min(i + length, n - 3)):
                seen[data[k : k + 4]] = k
            i += length
        else:
            out.append(data[i])
            i += 1
    return out


Token = int | tuple[int, int]
FILTERED = {0: lambda b, c, at: delta_encode(b, c), 1: lambda b, c, at: x86_encode(b, at), 2: lambda b, c, at: x86_encode(b, at, True), 3: lambda b, c, at: arm_encode(b, at)}


def _symbols(ts: Iterable[Token]) -> Iterator[tuple[int, int, int, int]]:
    """(table, symbol, extra bits, their value)."""
    for t in ts:
        if isinstance(t, int):
            yield 0, t, 0, 0
            continue
        length, distance = t
        slot, extra, value = _slot_of(length - (distance > 0x100) - (distance > 0x2000) - (distance > 0x40000))
        yield 0, MATCH + slot, extra, value
        slot, extra, value = _distance_slot(distance)
        if extra < 4:
            yield 1, slot, extra, value
        else:
            yield 1, slot, extra - 4, value >> 4
            yield 2, value & 15, 0, 0


def _number(value: int) -> Iterator[tuple[int, int, int, int]]:
    n = max(1, (value.bit_length() + 7) // 8)
    yield -1, 0, 2, n - 1
    for byte in value.to_bytes(n, "little"):
        yield -1, 0, 8, byte


def _filter_symbols(begin: int, length: int, kind: int, channels: int) -> Iterator[tuple[int, int, int, int]]:
    """A filter's record; table -1 stands for bits alone."""
    yield 0, FILTER, 0, 0
    yield from _number(begin)
    yield from _number(length)
    yield -1, 0, 3, kind
    if kind == 0:
        yield -1, 0, 5, channels - 1


def encode(data: bytes, matches: bool = True, filters: Sequence[tuple[int, int, int, int]] = ()) -> bytes:
    """One last block with its tables; with matches=False, literals only. `filters` (begin, length, kind, channels) must not overlap;
    their parts are filtered first, and their records stand at the front."""
    plain = bytearray(data)
    for begin, length, kind, channels in filters:
        plain[begin : begin + length] = FILTERED[kind](bytes(data[begin : begin + length]), channels, begin)
    records = [x for f in filters for x in _filter_symbols(*f)]
    return _block(records + list(_symbols(tokens(bytes(plain)) if matches else plain)), True)


def encode_blocks(data: bytes, size: int) -> Iterator[bytes]:
    """Blocks of about `size` plain bytes, each with its own tables, one at a time: matches reach over blocks."""
    part: list[Token] = []
    n = 0
    for t in tokens(data):
        part.append(t)
        n += 1 if isinstance(t, int) else t[0]
        if n >= size:
            yield _block(list(_symbols(part)), False)
            part, n = [], 0
    yield _block(list(_symbols(part)), True)


def price_tables(ts: Iterable[Token]) -> list[list[int]]:
    """Code lengths that fit the tokens; symbols that do not occur cost the most."""
    counts = [[0] * n for n in TABLES]
    for table, s, _, _ in _symbols(ts):
        counts[table][s] += 1
    return [[n or 15 for n in code_lengths(c)] if any(c) else [15] * len(c) for c in counts]


def price(t: Token, tables: list[list[int]]) -> int:
    return sum(tables[k][s] + extra for k, s, extra, _ in _symbols((t,)))


def refined(data: bytes, passes: int = 2, each: int = 32) -> list[Token]:
    """Tokens that cost the fewest bits under the code lengths of the pass before, the first of them from the greedy parse; the
    cheapest pass is kept. Lengths up to `each` are all tried, longer matches as they are."""
    from .matches import Tree

    best = ts = tokens(data)
    found = [m for m in Tree(data).all()]
    cheapest = None
    for _ in range(passes):
        tables = price_tables(ts)
        now = sum(price(t, tables) for t in ts)
        if cheapest is None:
            cheapest = now
        cost = [0, *([1 << 60] * len(data))]
        step: list[Token] = [0] * (len(data) + 1)
        for i, byte in enumerate(data):
            if (c := cost[i] + tables[0][byte]) < cost[i + 1]:
                cost[i + 1], step[i + 1] = c, byte
            shorter = 3
            for length, distance in found[i]:
                length = min(length, MOST_LENGTH - 3)
                for n in {*range(shorter + 1, min(length, each) + 1), length}:
                    if (c := cost[i] + price((n, distance), tables)) < cost[i + n]:
                        cost[i + n], step[i + n] = c, (n, distance)
                shorter = length
        ts, i = [], len(data)
        while i:
            ts.append(step[i])
            i -= 1 if isinstance(step[i], int) else step[i][0]
        ts.reverse()
        fresh = price_tables(ts)
        if (now := sum(price(t, fresh) for t in ts)) < cheapest:
            best, cheapest = ts, now
    return best


def encode_refined(data: bytes, passes: int = 2) -> bytes:
    """The smaller of the greedy and the refined parse, tables included."""
    return min(_block(list(_symbols(refined(data, passes))), True), encode(data), key=len)


def _block(stream: list[tuple[int, int, int, int]], last: bool) -> bytes:
    counts = [[0] * n for n in TABLES]
    for table, s, _, _ in stream:
        if table >= 0:
            counts[table][s] += 1
    lengths = [code_lengths(c) for c in counts]
    flat = [n for x in lengths for n in x]
    packed: list[tuple[int, int, int]] = []
    i = 0
    while i < len(flat):
        run = 1
        while i + run < len(flat) and flat[i + run] == flat[i] and run < 138:
            run += 1
        if flat[i] == 0 and run >= 3:
            packed.append((18, 3, run - 3) if run < 11 else (19, 7, run - 11))
            i += run
        else:
            packed.append((flat[i], 0, 0))
            i += 1
    pre = code_lengths([sum(p[0] == s for p in packed) for s in range(CODES)])
    out: list[str] = []
    for n in pre:
        out.append(f"{n:04b}" + ("0000" if n == 15 else ""))
    table = codes(pre)
    for s, extra, value in packed:
        c, n = table[s]
        out.append(f"{c:0{n}b}" + (f"{value:0{extra}b}" if extra else ""))
    all_codes = [codes(x) for x in lengths]
    for k, s, extra, value in stream:
        c, n = all_codes[k][s] if k >= 0 else (0, 0)
        out.append((f"{c:0{n}b}" if n else "") + (f"{value:0{extra}b}" if extra else ""))
    bits = "".join(out)
    size = (len(bits) + 7) // 8
    body = int(bits.ljust(size * 8, "0"), 2).to_bytes(size, "big")
    n = 1 if size < 256 else 2 if size < 65536 else 3
    flags = (0xC0 if last else 0x80) | n - 1 << 3 | (len(bits) - 1) % 8
    head = size.to_bytes(n, "little")
    check = 0x5A ^ flags
    for b in head:
        check ^= b
    return bytes((flags, check)) + head + body
