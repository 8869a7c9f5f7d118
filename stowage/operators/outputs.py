"""Members, links, volumes and containers written to files of a shared folder and read back.

Each query writes into a new folder of its own when it is built, and its result is read from the files.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as A
from ..functions import lz50
from ..plans.catalog import Catalog
from ..plans.storage import cut, scratch_folder
from ..sources import sinks
from ..sources.archives import members_of, read_blocks
from ..sources.tables import read
from .archives import _containers, _members
from .extraction import extract_sets, write_volumes

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def _done(report: DataFrame) -> None:
    """Runs a report for its effect."""
    report.write.format("noop").mode("overwrite").save()


def _files(spark, folder: str) -> DataFrame:
    """doc_id, digest of the files named by a document under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return f.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("digest"))


def _read(spark, folder: str) -> DataFrame:
    """The documents' members with payloads and verdicts; those of every seventh document are damaged."""
    m = members_of(read_blocks(_containers(spark, folder, "5+"), payload=True))
    return m.withColumn("doc_id", F.regexp_extract(F.decode("name", "UTF-8"), r"(\d+)\.txt$", 1).cast("long")).withColumn("payload_ok", F.col("payload_ok") & (F.col("doc_id") % 7 != 6))


_WHOLE = "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 7 <> 6"
_ALL = "SELECT doc_id, sha256(text) AS digest FROM documents"


class _Parts:
    """A writer for `extract_with`: files of a folder, one for a member."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, path: str, index: int, name: bytes):
        return open(os.path.join(self.folder, name.decode().rpartition("/")[2]), "wb")


@CATALOG.add("k01_extract_to_writer", _WHOLE)
def k01(spark, folder):
    """Each whole member goes through a caller's writer."""
    out = scratch_folder(spark, "writer")
    _done(sinks.extract_with(_read(spark, folder), _Parts(out)))
    return _files(spark, out)


@CATALOG.add("k02_extract_staged", _WHOLE)
def k02(spark, folder):
    """Staged, verified, published: what is damaged never shows."""
    out = scratch_folder(spark, "staged")
    _done(sinks.extract_to(sinks.plan_targets(_read(spark, folder)), out))
    sinks.drop_staging(out)
    return _files(spark, out)


@CATALOG.add("k03_extract_in_place", _ALL)
def k03(spark, folder):
    """Written straight to the files: damaged members show as far as they go."""
    out = scratch_folder(spark, "in-place")
    _done(sinks.extract_to(sinks.plan_targets(_read(spark, folder), "always"), out, "always", in_place=True))
    return _files(spark, out)


@CATALOG.add("k04_publish_verified", "SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'damaged' WHEN doc_id % 2 = 0 THEN 'exists' ELSE 'written' END AS status FROM documents")
def k04(spark, folder):
    """Half of the files are there before; the policy is never to replace one."""
    out = scratch_folder(spark, "published")
    m = sinks.plan_targets(_read(spark, folder))
    _done(sinks.extract_to(m.where("doc_id % 2 = 0"), out))
    report = cut(sinks.extract_to(m, out))
    sinks.drop_staging(out)
    return report.select(F.regexp_extract("target", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "status")


@CATALOG.add("k13_atomic_publish", "SELECT 'a' || doc_id // 64 || '.rar' AS file, count(*) AS members, true AS whole FROM documents GROUP BY 1")
def k13(spark, folder):
    """Built containers are published as whole files, and walked from there."""
    out = scratch_folder(spark, "containers")
    _done(sinks.containers_to(_containers(spark, folder, "5+").withColumnRenamed("path", "archive"), out))
    sinks.drop_staging(out)
    b = read_blocks(spark.read.format("binaryFile").option("pathGlobFilter", "*.rar").load(out).select("path", "content"), payload=True)
    return members_of(b).groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(F.count("*").alias("members"), F.bool_and("payload_ok").alias("whole"))


@CATALOG.add("k14_volume_sink", "SELECT doc_id AS set_id, lpad((i + 1)::VARCHAR, length(n::VARCHAR)::INT, '0') AS number FROM (SELECT doc_id, n, unnest(range(n)) AS i FROM (SELECT doc_id, greatest(1, (octet_length(encode(text)) + 1999) // 2000) AS n FROM documents))")
def k14(spark, folder):
    """Volumes go to a sink that is told their number first, so that names have one width."""
    out = scratch_folder(spark, "volumes")
    v = write_volumes(_members(spark, folder).select(F.col("member_index").alias("set_id"), "name", "payload"), 2000)
    _done(sinks.volumes_to(v, sinks.VolumeFolder(out)))
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.rar").load(out)
    return f.select(F.regexp_extract("path", r"(\d+)\.part(\d+)\.rar$", 1).cast("long").alias("set_id"), F.regexp_extract("path", r"(\d+)\.part(\d+)\.rar$", 2).alias("number"))


@CATALOG.add("k22_parallel_extract", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sha256(text) AS digest FROM conversations")
def k22(spark, folder):
    """Members of solid containers (even ones) form a chain for one decoder; all others are decoded each for itself. `place` is archive order."""
    schema = "conv_id long, turn long, place long, data binary"

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        decoder = lz50.Decoder()
        data = [(decoder if key[1] else lz50.Decoder()).decode(bytes(p), n) for p, n in zip(pdf.data, pdf.unpacked, strict=True)]
        return pdf[["conv_id", "turn", "place"]].assign(data=data)

    @F.pandas_udf("binary")
    def pack(data: pd.Series) -> pd.Series:
        return pd.Series([lz50.encode(bytes(b)) for b in data])

    from pyspark.sql import Window

    c = read(spark, folder, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("text"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1).withColumn("solid", F.col("conv_id") % 2 == 0)
    c = c.select("conv_id", "turn", "place", "solid", pack("text").alias("data"), F.length("text").alias("unpacked"))
    c = c.withColumn("chain", F.when(F.col("solid"), F.lit(0)).otherwise(F.col("place")))
    return c.groupBy("conv_id", "solid", "chain").applyInPandas(chain, schema).select("conv_id", "turn", "place", F.sha2("data", 256).alias("digest"))


# ------------------------------------------------------------------ links
def _linked(spark, folder: str) -> DataFrame:
    """page_id, kind, link_target, text: pages by turns a symlink, a hard link, a copy, a link out of the folder, or a link to a file that is missing."""
    p = read(spark, folder, "pages").select("page_id", F.encode("url", "UTF-8").alias("payload"))
    kind = F.element_at(F.array(*map(F.lit, ("symlink", "hard link", "copy", "symlink", "copy"))), (F.col("page_id") % 5 + 1).cast("int"))
    to = F.expr("CASE page_id % 5 WHEN 0 THEN concat('../files/', page_id, '.txt') WHEN 3 THEN '../../outside' WHEN 4 THEN 'files/none' ELSE concat('files/', page_id, '.txt') END")
    return p.select("page_id", "payload", kind.alias("kind"), to.alias("link_target"))


_LINKED = "SELECT page_id, CASE page_id % 5 WHEN 3 THEN 'unsafe' WHEN 4 THEN 'missing' ELSE 'written' END AS status, CASE WHEN page_id % 5 < 3 THEN sha256(url) END AS digest FROM pages"


def _through(report: DataFrame, folder: str) -> DataFrame:
    """page_id, status, and the digest of what is read at each link's place."""
    import hashlib

    @F.pandas_udf("string")
    def look(target: pd.Series, status: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(open(os.path.join(folder, t), "rb").read()).hexdigest() if s == "written" else None for t, s in zip(target, status, strict=True)], dtype=object)

    return report.select(F.col("path").cast("long").alias("page_id"), "status", look("target", "status").alias("digest"))


def _extracted(members: DataFrame, out: str) -> DataFrame:
    """Files first (page_id, payload), then the links to them."""
    files = members.where("payload is not null").select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("files/"), "page_id", F.lit(".txt")).alias("target"), "payload", F.lit(True).alias("payload_ok"))
    _done(sinks.extract_to(files, out))
    links = members.where("kind is not null").select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("links/"), "page_id").alias("target"), "kind", "link_target")
    report = cut(sinks.links_to(links, out))
    sinks.drop_staging(out)
    return _through(report, out)


@CATALOG.add("k25_create_links", _LINKED)
def k25(spark, folder):
    return _extracted(_linked(spark, folder), scratch_folder(spark, "links"))


@CATALOG.add("k24_extract_volumes_with_links", _LINKED)
def k24(spark, folder):
    """A set of volumes a page: its file is cut over them, and the last one holds the link to it."""
    codes = {"symlink": 1, "hard link": 4, "copy": 5}
    names = {v: k for k, v in codes.items()}

    def write(batches):
        for pdf in batches:
            rows = []
            for page, payload, kind, to in zip(pdf.page_id, pdf.payload, pdf.kind, pdf.link_target, strict=True):
                data = bytes(payload)
                half = len(data) // 2
                first = A.write50([{"name": b"file", "payload": data[:half], "unpacked": len(data), "split_after": True}], 0, True)
                last = A.write50([{"name": b"file", "payload": data[half:], "unpacked": len(data), "split_before": True}, {"name": b"link", "link": (codes[kind], 0, to.encode())}], 1)
                rows += [(page, 0, first), (page, 1, last)]
            yield pd.DataFrame(rows, columns=["set_id", "volume", "content"])

    @F.pandas_udf("struct<kind:string,link_target:string>")
    def link(data: pd.Series) -> pd.DataFrame:
        out = []
        for d in data:
            code, at = A.read_vint(d, 0)
            _, at = A.read_vint(d, at)
            n, at = A.read_vint(d, at)
            out.append({"kind": names[code], "link_target": bytes(d[at : at + n]).decode()})
        return pd.DataFrame(out, columns=["kind", "link_target"])

    v = cut(_linked(spark, folder).mapInPandas(write, "set_id long, volume int, content binary"))
    files = extract_sets(v).where("name = 'file' and whole").select(F.col("set_id").alias("page_id"), "payload", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("link_target"))
    record = F.get(F.filter("extras", lambda e: e["type"] == 5), 0)["data"]
    b = read_blocks(v.select(F.col("set_id").cast("string").alias("path"), "content")).where("kind = 'file'").withColumn("record", record).where("record is not null")
    links = b.select(F.col("path").cast("long").alias("page_id"), F.lit(None).cast("binary").alias("payload"), link("record").alias("x")).select("page_id", "payload", "x.*")
    return _extracted(files.unionByName(links), scratch_folder(spark, "volume-links"))


@CATALOG.add("f09_safe_output_join", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'inside/' || page_id WHEN 3 THEN page_id::VARCHAR END AS place FROM pages")
def f09(spark, folder):
    """Places under a folder that holds a folder and a link: through the link, or out of the root, there is none."""
    out = os.path.realpath(scratch_folder(spark, "joined"))
    os.mkdir(os.path.join(out, "inside"))
    os.symlink("inside", os.path.join(out, "link"))

    @F.pandas_udf("string")
    def place(relative: pd.Series) -> pd.Series:
        found = [sinks.safe_join(out, r) for r in relative]
        return pd.Series([f and os.path.relpath(f, out) for f in found], dtype=object)

    p = read(spark, folder, "pages")
    relative = F.expr("CASE page_id % 4 WHEN 0 THEN concat('inside/', page_id) WHEN 1 THEN concat('link/', page_id) WHEN 2 THEN concat('inside/../../', page_id) ELSE concat('./', page_id) END")
    return p.select("page_id", place(relative).alias("place"))
