"""Block splitting: the drift limit, the size limit, and the query against the kernel."""

import numpy as np

from stowage.functions.blocks import cuts
from stowage.operators.extraction import QUERIES


def histogram(data):
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def test_limits():
    base = bytes(65536)
    for changed, blocks in ((256, [0, 0]), (257, [0, 1])):
        assert cuts(np.stack([histogram(base), histogram(b"\1" * changed + base[changed:])])) == blocks
    assert cuts(np.stack([histogram(base)] * 20)) == [0] * 16 + [1] * 4


def test_query(spark, folder):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text}
    want = set()
    for i, b in texts.items():
        blocks = cuts(np.stack([histogram(b[k : k + 4096]) for k in range(0, len(b), 4096)]))
        want |= {(i, x, blocks.index(x), blocks.count(x)) for x in blocks}
    got = {(r.doc_id, r.block, r.first_chunk, r.chunks) for r in QUERIES["w07_block_splitting"](spark, folder).collect()}
    assert got == want
