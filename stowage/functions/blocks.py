"""Where a compressed block ends: it grows over a chunk whose bytes its own distribution describes."""

from __future__ import annotations

import numpy as np

#: Share of a chunk's bytes that may be misplaced, and the largest block.
DRIFT, MOST = 128, 1 << 20


def cuts(histograms: np.ndarray) -> list[int]:
    """Block number of each chunk, from the 256 byte counts of the chunks in order; integers only, so that all platforms agree."""
    out: list[int] = []
    block, counts, total = -1, np.zeros(256, np.int64), 0
    for h in histograms.astype(np.int64):
        n = int(h.sum())
        fits = 0 < total and 0 < n and total + n <= MOST and int(np.abs(h * total - counts * n).sum()) // total <= n // DRIFT
        if fits:
            counts, total = counts + h, total + n
        else:
            block, counts, total = block + 1, h, n
        out.append(block)
    return out
