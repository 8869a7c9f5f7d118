"""The compressed payloads of formats 2.0 and 2.9 to 4: adaptive code tables, literals, matches and, in 2.0, audio blocks.

Both formats share one shape, which `Layout` describes: a main alphabet of literals, controls and lengths, tables
of distances and repeated-match lengths, and tables that are stored as differences to the tables before. The
decoder and the encoder walk the same description. The decoder keeps its history, so that a solid chain is decoded
by one object, member after member. Text-model blocks and filter programs of 2.9 are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from .lz50 import Bits, Window, canonical, code_lengths, codes, symbol, tokens

# Fixed values of the formats: base and extra bits of lengths, and of the distances of two-byte matches
LENGTH_BASE = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224)
LENGTH_BITS = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5)
NEAR_BASE = (0, 4, 8, 16, 32, 64, 128, 192)
NEAR_BITS = (2, 2, 3, 4, 5, 6, 6, 6)
FAR, FARTHER, AUDIO_SIZE, AUDIO_END = 0x2000, 0x40000, 257, 256


def _distances(widest: int, counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """Base and extra bits of the distance slots: four without, then two of each width, or as many as `counts` says."""
    bits = [0] * 4 + [n for n in range(1, widest + 1) for _ in range(counts.get(n, 2))]
    base, at = [], 0
    for n in bits:
        base.append(at)
        at += 1 << n
    return base, bits


@dataclass(frozen=True)
class Layout:
    sizes: tuple[int, ...]  # main, distances, (low distances,) lengths of repeated matches
    pre: int  # symbols of the code that stores code lengths
    runs: dict[int, tuple[int, int, bool]]  # symbol -> extra bits, least run, whether it repeats the length before
    near: int  # first symbol of two-byte matches
    match: int  # first symbol of other matches
    old: int  # first of four symbols for earlier distances
    again: int  # the whole last match
    fresh: int  # new tables follow (2.0), the block ends (2.9)
    distances: tuple[list[int], list[int]]
    audio: bool  # 2.0: audio blocks, and every match counts as a recent one


# The two layouts
V20 = Layout((298, 48, 28), 19, {16: (2, 3, True), 17: (3, 3, False), 18: (7, 11, False)}, 261, 270, 257, 256, 269, _distances(16, {16: 14}), True)
V29 = Layout((299, 60, 17, 28), 20, {16: (3, 3, True), 17: (7, 11, True), 18: (3, 3, False), 19: (7, 11, False)}, 263, 271, 259, 258, 256, _distances(18, {16: 14, 17: 0, 18: 12}), False)


class Predictor:
    """Guesses a sample from the last one and the weighted differences before it; weights move by one step every 32 samples.

    taps: how many differences count; beside: whether the last step of the channel before counts too (2.0 alone).
    """

    def __init__(self, taps: int, beside: bool) -> None:
        self.taps, self.beside = taps, beside
        self.weights = [0] * (taps + beside)
        self.steps = [0] * (taps + 1)  # steps[0]: the last one; then differences of earlier ones
        self.last = self.n = 0
        self.errors = [0] * (1 + 2 * len(self.weights))

    def inputs(self, other: int) -> list[int]:
        step, d = self.steps[0], self.steps[1:]
        d = [step, step - d[0], *d[1:-1]] if self.taps > 1 else [step]
        self.steps[1:] = d
        return d + [other] * self.beside

    def next(self, value: int, other: int, decode: bool) -> tuple[int, int]:
        """(sample, error as it is stored) from either of them, and the state moves on."""
        x = self.inputs(other)
        guess = 8 * self.last + sum(w * v for w, v in zip(self.weights, x, strict=True)) >> 3 & 255
        error = value if decode else guess - value & 255
        sample = guess - error & 255
        e = (error ^ 128) - 128 << 3
        sums = self.errors
        sums[0] += abs(e)
        for k, v in enumerate(x):
            sums[2 * k + 1] += abs(e - v)
            sums[2 * k + 2] += abs(e + v)
        self.steps[0] = (sample - self.last + 128 & 255) - 128
        self.last = sample
        return sample, error

    def settle(self) -> None:
        """The weight whose change would have helped most moves by one."""
        best = min(range(len(self.errors)), key=self.errors.__getitem__)
        self.errors = [0] * len(self.errors)
        if best:
            k, up = (best - 1) // 2, best % 2 == 0
            if up and self.weights[k] < 16:
                self.weights[k] += 1
            elif not up and self.weights[k] >= -16:
                self.weights[k] -= 1


def audio_filter(data: bytes, channels: int, decode: bool = True) -> bytes:
    """The audio filter of 2.9: planes of prediction errors, one channel after the other, to interleaved samples, or back."""
    n, at, out = len(data), 0, bytearray(len(data))
    for c in range(channels):
        p = Predictor(3, False)
        for count, i in enumerate(range(c, n, channels)):
            sample, error = p.next(data[at] if decode else data[i], 0, decode)
            if decode:
                out[i] = sample
            else:
                out[at] = error
            at += 1
            if count % 32 == 0:
                p.settle()
    return bytes(out)


class Decoder:
    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.history = bytearray()
        self.recent = [0, 0, 0, 0]  # the last first
        self.length = self.distance = 0
        self.low = self.low_again = 0
        self.lengths = [0] * max(sum(layout.sizes), 4 * AUDIO_SIZE)
        self.tables: list | None = None
        self.audio: list[Predictor] = []
        self.channel = self.step = 0

    def read_tables(self, bits: Bits) -> None:
        y, self.audio = self.layout, self.audio
        if not y.audio:
            bits.at = (bits.at + 7) & ~7
            if bits.take(1):
                raise ValueError("text-model blocks are not supported")
            self.low = self.low_again = 0
            sound, total = False, sum(y.sizes)
        else:
            sound = bool(bits.take(1))
        if not bits.take(1):
            self.lengths = [0] * len(self.lengths)
        channels = 0
        if y.audio:
            channels = bits.take(2) + 1 if sound else 0
            total = channels * AUDIO_SIZE if sound else sum(y.sizes)
        pre: list[int] = []
        while len(pre) < y.pre:
            n = bits.take(4)
            if not y.audio and n == 15 and (zeros := bits.take(4)):
                pre += [0] * (zeros + 2)
            else:
                pre.append(n)
        table, new = canonical(pre[: y.pre]), []
        while len(new) < total:
            s = symbol(bits, table)
            if s < 16:
                new.append(s + self.lengths[len(new)] & 15)
                continue
            extra, least, before = y.runs[s]
            if before and not new:
                raise ValueError("nothing to repeat")
            new += [new[-1] if before else 0] * (bits.take(extra) + least)
        self.lengths[:total] = new[:total]
        at, self.tables = 0, []
        for size in [AUDIO_SIZE] * channels if sound else y.sizes:
            self.tables.append(canonical(new[at : at + size]))
            at += size
        if sound:
            self.audio = (self.audio + [Predictor(4, True) for _ in range(channels)])[:channels]
            self.channel %= channels
        self.sound = sound

    def _copy(self, length: int, distance: int) -> None:
        out = self.history
        if not 0 < distance <= len(out):
            raise ValueError("match reaches before the start")
        self.length, self.distance = length, distance
        from_ = len(out) - distance
        out += out[from_ : from_ + length] if distance >= length else (out[from_:] * (length // distance + 1))[:length]

    def _far(self, bits: Bits, far: list, low: list | None) -> int:
        base, width = self.layout.distances
        slot = symbol(bits, far)
        distance, n = base[slot] + 1, width[slot]
        if low is None or slot <= 9:
            return distance + (bits.take(n) if n else 0)
        if n > 4:
            distance += bits.take(n - 4) << 4
        if self.low_again:
            self.low_again -= 1
        elif (s := symbol(bits, low)) == 16:
            self.low_again = 15
        else:
            self.low = s
        return distance + self.low

    def decode(self, data: bytes, size: int) -> bytes:
        """The next member of the chain."""
        y, out, start = self.layout, self.history, len(self.history)
        bits = Window(data, len(data) * 8)
        if size:
            self.read_tables(bits)
        while len(out) - start < size:
            if self.sound:
                s = symbol(bits, self.tables[self.channel])
                if s == AUDIO_END:
                    self.read_tables(bits)
                    continue
                p = self.audio[self.channel]
                sample, _ = p.next(s, self.step, True)
                self.step = p.steps[0]
                p.n += 1
                if p.n % 32 == 0:
                    p.settle()
                out.append(sample)
                self.channel = (self.channel + 1) % len(self.audio)
                continue
            main, far, *low, repeated = self.tables
            s = symbol(bits, main)
            if s < 256:
                out.append(s)
            elif s >= y.match:
                length = LENGTH_BASE[s - y.match] + 3 + (bits.take(n) if (n := LENGTH_BITS[s - y.match]) else 0)
                distance = self._far(bits, far, low[0] if low else None)
                self.recent = [distance, *self.recent[:3]]
                self._copy(length + (distance >= FAR) + (distance >= FARTHER), distance)
            elif s == y.again:
                if self.length:
                    if y.audio:
                        self.recent = [self.distance, *self.recent[:3]]
                    self._copy(self.length, self.recent[0])
            elif s == y.fresh:
                if not y.audio and not bits.take(1):
                    break  # the member ends
                self.read_tables(bits)
            elif y.old <= s < y.old + 4:
                distance = self.recent[s - y.old]
                slot = symbol(bits, repeated)
                length = LENGTH_BASE[slot] + 2 + (bits.take(n) if (n := LENGTH_BITS[slot]) else 0)
                if y.audio:  # every match is a recent one
                    length += (distance > 0x100) + (distance >= FAR) + (distance >= FARTHER)
                    self.recent = [distance, *self.recent[:3]]
                else:
                    self.recent = [distance, *(d for i, d in enumerate(self.recent) if i != s - y.old)]
                self._copy(length, distance)
            elif s >= y.near:
                distance = NEAR_BASE[s - y.near] + 1 + bits.take(NEAR_BITS[s - y.near])
                self.recent = [distance, *self.recent[:3]]
                self._copy(2, distance)
            else:
                raise ValueError("filter programs are not supported")
        if len(out) - start < size:
            raise ValueError("payload is too short")
        del out[start + size :]
        return bytes(out[start:])


# ------------------------------------------------------------------ encoding
def _place(value: int, base) -> int:
    """The last slot whose base is at most a value."""
    lo, hi = 0, len(base)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if base[mid] <= value else (lo, mid)
    return lo


def _packed_lengths(y: Layout, flat: list[int]) -> str:
    """Code lengths behind their own code; runs of zeros are shortened."""
    short, long = ((17, 18) if y.audio else (18, 19))
    parts, i = [], 0
    while i < len(flat):
        run = 1
        while i + run < len(flat) and flat[i + run] == flat[i] and run < 138:
            run += 1
        if flat[i] or run < 3:
            parts.append((flat[i], 0, 0))
            i += 1
        else:
            parts.append((short, 3, run - 3) if run < 11 else (long, 7, run - 11))
            i += run
    pre = code_lengths([sum(p[0] == s for p in parts) for s in range(y.pre)])
    table = codes(pre)
    head = "".join(f"{n:04b}" + ("0000" if n == 15 and not y.audio else "") for n in pre)
    return head + "".join(f"{table[s][0]:0{table[s][1]}b}" + (f"{v:0{e}b}" if e else "") for s, e, v in parts)


def _written(bits: str) -> bytes:
    size = (len(bits) + 7) // 8
    return int(bits.ljust(size * 8, "0") or "0", 2).to_bytes(size, "big")


def encode(data: bytes, layout: Layout) -> bytes:
    """One block with its tables, made of literals and matches."""
    y, (base, width) = layout, layout.distances
    stream: list[tuple[int, int, int, int]] = []  # (table, symbol, extra bits, their value)
    for t in tokens(data, 1 << 17, 255):
        if isinstance(t, int):
            stream.append((0, t, 0, 0))
            continue
        length, distance = t
        v = length - 3 - (distance >= FAR) - (distance >= FARTHER)
        slot = _place(v, LENGTH_BASE)
        stream.append((0, y.match + slot, LENGTH_BITS[slot], v - LENGTH_BASE[slot]))
        slot = _place(distance - 1, base)
        n, v = width[slot], distance - 1 - base[slot]
        if not y.audio and slot > 9:
            stream += [(1, slot, n - 4, v >> 4), (2, v & 15, 0, 0)]
        else:
            stream.append((1, slot, n, v))
    if not y.audio:
        stream.append((0, y.fresh, 2, 1))  # the member ends; the next one has tables of its own
    counts = [[0] * n for n in y.sizes]
    for table, s, _, _ in stream:
        counts[table][s] += 1
    lengths = [code_lengths(c) for c in counts]
    all_codes = [codes(x) for x in lengths]
    body = "".join(f"{all_codes[k][s][0]:0{all_codes[k][s][1]}b}" + (f"{v:0{e}b}" if e else "") for k, s, e, v in stream)
    return _written("00" + _packed_lengths(y, [n for x in lengths for n in x]) + body)


def encode_audio(data: bytes, channels: int) -> bytes:
    """One audio block of 2.0."""
    predictors, step, stream = [Predictor(4, True) for _ in range(channels)], 0, []
    for i, b in enumerate(data):
        p = predictors[i % channels]
        _, error = p.next(b, step, False)
        step = p.steps[0]
        p.n += 1
        if p.n % 32 == 0:
            p.settle()
        stream.append((i % channels, error))
    counts = [[0] * AUDIO_SIZE for _ in range(channels)]
    for k, s in stream:
        counts[k][s] += 1
    lengths = [code_lengths(c) for c in counts]
    all_codes = [codes(x) for x in lengths]
    body = "".join(f"{all_codes[k][s][0]:0{all_codes[k][s][1]}b}" for k, s in stream)
    return _written(f"10{channels - 1:02b}" + _packed_lengths(V20, [n for x in lengths for n in x]) + body)
