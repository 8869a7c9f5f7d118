"""Maps over whole payloads in Arrow batches: byte counts, sector parity and repair, delta planes. Null stays null."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR, SLOTS = 64, 4


def _each(f, returns: str):
    @F.pandas_udf(returns)
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else f(np.frombuffer(b, np.uint8)) for b in data])

    return run


def _records(f, returns: str):
    @F.pandas_udf(returns)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(np.frombuffer(b or b"", np.uint8)) for b in data])

    return run


def counts(x: np.ndarray) -> np.ndarray:
    return np.bincount(x, minlength=256)


def chunk_counts(x: np.ndarray, chunk: int) -> np.ndarray:
    """A row of 256 counts for each chunk of a payload."""
    n = -(-len(x) // chunk)
    return np.bincount(np.arange(len(x)) // chunk * 256 + x, minlength=256 * n).reshape(n, 256)


def sectors(x: np.ndarray) -> np.ndarray:
    """The payload as rows of SECTOR bytes, the last one filled up with zeros."""
    return np.pad(x, (0, -len(x) % SECTOR)).reshape(-1, SECTOR)


def parities(rows: np.ndarray) -> np.ndarray:
    """The exclusive or of the sectors of each slot; sector i goes to slot i modulo SLOTS."""
    return np.stack([np.bitwise_xor.reduce(rows[k::SLOTS], axis=0) for k in range(SLOTS)]) if len(rows) else np.zeros((SLOTS, SECTOR), np.uint8)


def _slot_parity(x: np.ndarray) -> list:
    out = parities(sectors(x)).ravel().astype(object)
    out[min(len(x), SLOTS * SECTOR) :] = None  # places that no byte reaches
    return out.tolist()


def _second_sector(x: np.ndarray) -> dict:
    """The second sector is lost and solved from its slot's parity and the others; `weighted` adds up its bytes by their places."""
    rows, lost = sectors(x), 1
    size = max(0, min(len(x) - SECTOR, SECTOR))
    if not size:
        return {"repaired": 0, "weighted": 0}
    parity = parities(rows)[lost % SLOTS]
    others = [i for i in range(lost % SLOTS, len(rows), SLOTS) if i != lost]
    back = parity ^ np.bitwise_xor.reduce(rows[others], axis=0) if others else parity
    return {"repaired": size, "weighted": int((back[:size].astype(np.int64) * (np.arange(size) + SECTOR + 1)).sum())}


def tagged_repairs(x: np.ndarray) -> int:
    """Sectors carry a tag of 16 check bits; the second one is damaged, told by its tag and rebuilt from its slot. The number of sectors that match their tag again.

    One damage in 65,536 keeps the tag. It shows in the check of the whole payload: then the slot whose parity does not hold
    is searched for the sector that, rebuilt, makes the payload match.
    """
    rows = sectors(x)
    tag = [zlib.crc32(r.tobytes()) & 0xFFFF for r in rows]
    parity, seen, whole = parities(rows), rows.copy(), zlib.crc32(rows.tobytes())
    if len(rows) > 1:
        seen[1] = 0
        seen[1, 0] = 255
    bad = [i for i, r in enumerate(seen) if zlib.crc32(r.tobytes()) & 0xFFFF != tag[i]]
    if not bad and zlib.crc32(seen.tobytes()) != whole:
        bad = untagged(seen, parity, whole)
    fixed = 0
    for i in bad:
        own = [j for j in range(i % SLOTS, len(rows), SLOTS) if j not in bad]
        back = parity[i % SLOTS] ^ (np.bitwise_xor.reduce(seen[own], axis=0) if own else np.uint8(0))
        fixed += zlib.crc32(back.tobytes()) & 0xFFFF == tag[i]
    return fixed


def untagged(seen: np.ndarray, parity: np.ndarray, whole: int) -> list[int]:
    """The one sector whose rebuilt bytes give the payload its check back, though all tags hold; none if it can't be told."""
    off = parities(seen) ^ parity
    found = []
    for i in range(len(seen)):
        if off[i % SLOTS].any():
            trial = seen.copy()
            trial[i] ^= off[i % SLOTS]
            if zlib.crc32(trial.tobytes()) == whole:
                found.append(i)
    return found if len(found) == 1 else []


def delta_sums(decode: bool, channels: int = 3):
    """weighted (values by their places) and n of a payload's interleaved delta channels, decoded or encoded."""

    def f(x: np.ndarray) -> dict:
        out = np.empty(len(x), np.int64)
        for c in range(channels):
            own = x[c::channels].astype(np.int64)
            out[c::channels] = (-np.cumsum(own) if decode else -np.diff(own, prepend=0)) % 256
        return {"weighted": int((out * (np.arange(len(x)) + 1)).sum()), "n": len(x)}

    return _records(f, "weighted long, n long")


# column functions: a pandas UDF needs a session, so each is made when it is called
def histogram(data) -> Column:
    """256 counts."""
    return _each(counts, "array<long>")(data)


def slot_parity(data) -> Column:
    """SLOTS * SECTOR bytes of parity, null where no byte of the payload reaches."""
    return _each(_slot_parity, "array<int>")(data)


def second_sector(data) -> Column:
    return _records(_second_sector, "repaired long, weighted long")(data)


def tagged(data) -> Column:
    return _each(tagged_repairs, "long")(data)
