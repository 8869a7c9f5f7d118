"""Block walks over seekable readers: headers are read by ranges, payloads are jumped over."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

from . import formats as A

HEAD = 4096  # read at a block's place; a longer header asks for more


class Counted(io.BytesIO):
    """A reader that adds up what is read."""

    def __init__(self, data: bytes) -> None:
        super().__init__(data)
        self.bytes_read = 0

    def read(self, size: int | None = -1) -> bytes:
        out = super().read(size)
        self.bytes_read += len(out)
        return out


def _size(reader) -> int:
    return reader.seek(0, io.SEEK_END)


def _at(reader, place: int, n: int) -> bytes:
    reader.seek(place)
    return reader.read(n)


def walk(reader, head: int = HEAD) -> Iterator[dict]:
    """The blocks of a container behind `reader` (seek and read), with the columns and places of `formats.parse`.

    No more than `head` bytes are read for a block, unless its header is longer. Format 1.3 has no block sizes ahead
    of its names and is read whole.
    """
    size = _size(reader)
    first = _at(reader, 0, min(size, A.SCAN + 64)) if size <= head else _at(reader, 0, head)
    found = A.find_signature(first) or (A.find_signature(_at(reader, 0, A.SCAN + 64)) if size > head else None)
    if found is None or found[0] == "1.3":
        yield from A.parse(_at(reader, 0, size))
        return
    family, place, length = found
    parse: Callable = A.parse50 if family == "5+" else A.parse15
    at, n = place + length, 0
    while at < size:
        want = head
        while True:
            x = next(parse(_at(reader, at, want), 0))
            if x["kind"] != "cut" or at + want >= size:
                break
            want *= 2
        if x["kind"] == "cut":
            yield x | {"block": n, "offset": at}
            return
        behind = at + x["data_offset"]
        yield x | {"block": n, "offset": at, "data_offset": behind, "error": "payload is cut short" if behind + x["packed"] > size else x["error"] if x["error"] != "payload is cut short" else None}
        at, n = behind + x["packed"], n + 1
        if x["kind"] == "end":
            return
    if family == "5+":
        yield A.row(family=family, block=n, kind="cut", header_ok=False, offset=at, error="no end block")
    elif not n:
        yield A.row(family=family, block=0, kind="cut", header_ok=False, offset=at, error="no main block")


def payload(reader, x: dict) -> bytes:
    """The packed bytes of a block."""
    return _at(reader, x["data_offset"], x["packed"])
