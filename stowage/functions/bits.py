"""Column functions over bits and integers: header fields, dictionary sizes, recovery plans, byte arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats
DICTIONARY = 128 * 1024
LEVEL_EFFORT = (0, 8, 32, 128, 256, 512)
SHARDS, KIB, CHUNK_HEADER = 200, 1024, 72
SAMPLE, SAMPLE_ALIGN, EDGE = 128 * 1024, 12, 64


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of numbers 0 to 255."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)")), lambda x: F.conv(x, 16, 10).cast("int"))


def little_endian(values: Column) -> Column:
    """The number whose bytes, least significant first, an array holds."""
    return F.aggregate(F.reverse(values), F.lit(0).cast("long"), lambda s, b: s * 256 + b)


def vint(values: Column) -> Column:
    """value and length of a variable-length number at the start of an array of bytes: 7 bits a byte, at most ten; null where it is cut short or passes 63 bits."""
    indexed = F.transform(values, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    n = F.aggregate(indexed, F.lit(0), lambda s, x: F.when((s == 0) & (x["b"] < 128), x["i"] + 1).otherwise(s))
    total = F.aggregate(F.reverse(F.slice(values, F.lit(1), n)), F.lit(0).cast("decimal(38,0)"), lambda s, b: (s * 128 + b.bitwiseAND(127)).cast("decimal(38,0)"))
    return F.when((n > 0) & (n <= 10) & (total <= F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.struct(total.cast("long").alias("value"), n.alias("length")))


def compression_info(raw: Column) -> Column:
    """algorithm, solid, method, power, fraction, compatible, dictionary of a format 5+ word; null where its fields contradict each other."""
    field = lambda s, m: F.shiftright(raw, s).bitwiseAND(m)
    version, power, fraction, compatible = raw.bitwiseAND(63), field(10, 31), field(15, 31), raw.bitwiseAND(0x100000) != 0
    good = (version <= 1) & ~((version == 0) & ((fraction != 0) | compatible | (power > 15)))
    size = F.when(version == 1, (fraction + 32) * F.expr("1L") * F.pow(F.lit(2), power + 12).cast("long")).otherwise(F.lit(DICTIONARY).cast("long") * F.pow(F.lit(2), power).cast("long"))
    return F.when(good, F.struct(version.alias("algorithm"), (raw.bitwiseAND(64) != 0).alias("solid"), field(7, 7).alias("method"), power.alias("power"), fraction.alias("fraction"), compatible.alias("compatible"), size.alias("dictionary")))


def fitted_dictionary(content: Column, cap: Column) -> Column:
    """The least size, 128 KiB doubled, that passes the content, stopped at the cap."""
    sizes = F.array(*[F.lit(DICTIONARY << k).cast("long") for k in range(16)])
    return F.least(F.coalesce(F.get(F.filter(sizes, lambda s: s > content), 0), F.lit(DICTIONARY << 15).cast("long")), cap)


def dictionary_fields(size: Column) -> Column:
    """power and fraction of the later algorithm's dictionary size: (fraction + 32) * 2**(power + 12); null where it is not encodable."""
    powers = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda p: (size % (F.pow(F.lit(2), p) * 4096).cast("long") == 0) & (size >= (F.pow(F.lit(2), p) * 4096 * 32).cast("long")) & (size <= (F.pow(F.lit(2), p) * 4096 * 63).cast("long")))
    p = F.get(powers, 0)
    return F.when(p.isNotNull(), F.struct(p.alias("power"), (F.expr("1L") * (size / (F.pow(F.lit(2), p) * 4096))).cast("int").alias("mantissa")))


def recovery_plan(size: Column, percent: Column) -> Column:
    """data_shards (200 at most), recovery_shards, group_count (even), header_size and shard_size for an archive size and a percentage."""
    pct = F.least(percent, F.lit(100))
    data = F.when(size >= SHARDS * KIB, F.lit(SHARDS).cast("long")).otherwise(F.greatest(F.ceil(size / KIB), F.lit(1)))
    parity = F.least(F.floor(2 * pct * data / 200), data)
    parity = F.when((parity == 0) & (size < SHARDS * KIB), F.lit(1)).otherwise(parity)
    group = F.ceil(size / data)
    group = group + group.bitwiseAND(1)
    header = data * 8 + CHUNK_HEADER
    return F.struct(data.alias("data_shards"), parity.cast("long").alias("recovery_shards"), group.alias("group_count"), header.alias("header_size"), (header + group).alias("shard_size"))


def sample_range(n: Column) -> Column:
    """start and end of a window of 128 KiB in the middle, aligned to 12 bytes."""
    middle = F.floor((n - SAMPLE) / 2)
    start = middle - middle % SAMPLE_ALIGN
    return F.when(n <= SAMPLE, F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"))).otherwise(F.struct(start.alias("start"), (start + SAMPLE).alias("end")))


def delta_range(n: Column, channels: Column) -> Column:
    """start and end of a delta filter's range: without 64 bytes at both ends, aligned to the channels; null where too little is left."""
    start = EDGE + F.pmod(channels - EDGE % channels, channels)
    end = n - EDGE
    last = end - (end - start) % channels
    ok = (channels > 0) & (n > 2 * EDGE + channels * 8) & (start + channels * 8 <= last)
    return F.when(ok, F.struct(start.cast("long").alias("start"), last.cast("long").alias("end")))


def rotating_checksum(values: Column) -> Column:
    """The 16-bit checksum of format 1.3: add a byte, rotate left by one."""
    def step(s: Column, b: Column) -> Column:
        v = (s + b).bitwiseAND(65535)
        return (v * 2).bitwiseAND(65535) + F.floor(v / 32768).cast("long")

    return F.aggregate(values, F.lit(0).cast("long"), step)
