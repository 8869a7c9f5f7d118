"""Comments that formats 1.5 to 2.9 keep inside headers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as A
from ..functions import lzold
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..sources.tables import read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

#: Codecs by the version a comment names; the codec of version 15 is not there.
CODECS = {20: lzold.V20, 26: lzold.V20, 29: lzold.V29, 36: lzold.V29}


def decode_comment(c: dict) -> tuple[bytes | None, str]:
    """(text, status) of a comment block: whole, damaged (its check value does not fit), or unsupported (no codec of its version)."""
    if c["method"] == 0:
        text = c["data"][: c["unpacked"]]
    elif c["version"] not in CODECS:
        return None, "unsupported"
    else:
        try:
            text = lzold.Decoder(CODECS[c["version"]]).decode(c["data"], c["unpacked"])
        except (ValueError, IndexError):
            return None, "damaged"
    return (text, "whole") if zlib.crc32(text) & 0xFFFF == c["check"] else (None, "damaged")


def read_comments(containers: DataFrame) -> DataFrame:
    """path, member_index (null: the container's own), version, method, header_ok, comment, status for each comment inside a header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                for n, c in A.comments15(bytes(content or b"")):
                    rows.append((path, n, c["version"], c["method"], c["header_ok"], *decode_comment(c)))
            yield pd.DataFrame(rows, columns=["path", "member_index", "version", "method", "header_ok", "comment", "status"]).astype({"member_index": "Int64"})

    return containers.select("path", "content").mapInPandas(run, "path string, member_index long, version int, method int, header_ok boolean, comment binary, status string")


@CATALOG.add("s36_nested_comments", "SELECT page_id, m.i AS member_index, CASE WHEN m.i IS NULL THEN 15 ELSE 29 END AS version, 0 AS method, true AS header_ok FROM pages, (VALUES (NULL), (1)) m(i)")
def s36(spark, folder):
    """A container's own comment, and one of its second member."""
    make = binary_kernel(lambda b: A.write15([{"name": b"a", "payload": b"x"}, {"name": b"b", "payload": b"yy", "comment": A.comment15(b, version=29)}, {"name": b"c"}], comment=A.comment15(b)))
    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make(F.encode("url", "UTF-8")).alias("content"))
    return read_comments(c).select(F.col("path").cast("long").alias("page_id"), F.col("member_index").cast("int").alias("member_index"), "version", "method", "header_ok")


@CATALOG.add("c30_member_comments", "SELECT page_id, page_id % 3 AS member_index, CASE WHEN page_id % 4 <> 0 THEN url END AS comment, CASE WHEN page_id % 4 = 0 THEN 'damaged' ELSE 'whole' END AS status FROM pages")
def c30(spark, folder):
    """Comments of members, packed by the codecs of 2.0 and 2.9 or stored; every fourth is damaged after its check value was set."""

    @F.pandas_udf("binary")
    def make(page: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for i, u in zip(page, url, strict=True):
            i, text = int(i), u.encode()
            version = (15, 20, 29)[i // 3 % 3]
            told = text if i % 4 else text[:-1] + bytes((text[-1] ^ 1,))
            c = A.comment15(text, None if version == 15 else lzold.encode(told, CODECS[version]), version)
            c = c.replace(text, told) if version == 15 else c
            out.append(A.write15([{"name": b"m%d" % k, "payload": b"p" * k, **({"comment": c} if k == i % 3 else {})} for k in range(3)]))
        return pd.Series(out)

    p = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id", "url").alias("content"))
    return read_comments(p).select(F.col("path").cast("long").alias("page_id"), F.col("member_index").cast("int").alias("member_index"), F.decode("comment", "UTF-8").alias("comment"), "status")
