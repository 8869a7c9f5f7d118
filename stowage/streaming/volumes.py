"""Volumes that arrive over time, folded with keyed state.

State of a set: the run of consecutive volumes so far. A run is emitted when its set's last volume
comes (complete), when a later volume shows a gap (missing_volume), when a volume comes that the run has
passed already (out_of_order), or when nothing came for `timeout` (missing_volume): containers
have no event time, so waiting for a missing volume is bounded by processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "set_id long, first_volume long, last_volume long, fragments long, packed_size long, status string"
STATE = "first long, last long, fragments long, packed long"
INPUT = "set_id long, volume long, packed_size long, is_last boolean"


def _row(set_id: int, run: tuple, status: str) -> tuple:
    return (set_id, *run, status)


def advance(set_id: int, run: tuple | None, volumes: list[tuple[int, int, bool]]) -> tuple[list[tuple], tuple | None]:
    """Rows to emit and the run that stays, after some volumes (number, packed size, is last) of a set."""
    out: list[tuple] = []
    for volume, packed, is_last in sorted(volumes):
        if run is not None and volume <= run[1]:
            out.append((set_id, volume, volume, 1, packed, "out_of_order"))
            continue
        if run is not None and volume > run[1] + 1:
            out.append(_row(set_id, run, "missing_volume"))
            run = None
        run = (volume, volume, 1, packed) if run is None else (run[0], volume, run[2] + 1, run[3] + packed)
        if is_last:
            out.append(_row(set_id, run, "complete"))
            run = None
    return out, run


def fold_stream(volumes: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Streaming (or batch) rows of INPUT to rows of OUTPUT."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([_row(key[0], run, "missing_volume")], columns=[c.split()[0] for c in OUTPUT.split(", ")])
            return
        seen = [r for pdf in batches for r in zip(pdf.volume.tolist(), pdf.packed_size.tolist(), pdf.is_last.tolist(), strict=True)]
        out, run = advance(int(key[0]), run, seen)
        if run is None:
            if state.exists:
                state.remove()
        else:
            state.update(run)
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return volumes.groupBy("set_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Progress events by phase and time window, with a watermark for late ones."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("completed"))


PIECES = "set_id long, volume long, piece binary, is_last boolean"
WHOLE = "set_id long, volumes long, payload binary"


def walk_split(held: dict[int, bytes], last: int | None, pieces: list[tuple[int, bytes, bool]]) -> tuple[bytes | None, dict[int, bytes], int | None]:
    """The payload of a member cut over volumes 0 to `last`, once all are there, and what is held until then. A volume that comes again is kept once."""
    held = dict(held)
    for volume, piece, is_last in pieces:
        held.setdefault(volume, piece)
        last = volume if is_last else last
    if last is not None and all(v in held for v in range(last + 1)):
        return b"".join(held[v] for v in range(last + 1)), {}, None
    return None, held, last


def join_stream(pieces: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Streaming rows of PIECES to rows of WHOLE: pieces may come in any order, and a member is emitted with its last one. The state of a set that
    stays incomplete is given up when nothing came for `timeout_ms`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, parts, last = state.get if state.exists else ([], [], None)
        seen = [(v, bytes(p), e) for pdf in batches for v, p, e in zip(pdf.volume.tolist(), pdf.piece, pdf.is_last.tolist(), strict=True)]
        end = next((v for v, _, is_last in seen if is_last), last)
        payload, held, last = walk_split(dict(zip(numbers, map(bytes, parts), strict=True)), last, seen)
        if payload is None:
            state.update((list(held), list(held.values()), last))
            state.setTimeoutDuration(timeout_ms)
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"set_id": [key[0]], "volumes": [end + 1], "payload": [payload]})

    return pieces.groupBy("set_id").applyInPandasWithState(step, WHOLE, "numbers array<long>, parts array<binary>, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
