"""Plans that are built, read back through the facade, and rewritten."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as A
from ..plans.catalog import Catalog
from ..plans.facade import CODES, ArchiveFrame, ArchivePlan, ReadOptions, look, with_codes
from ..plans.storage import scratch_folder
from ..sources.archives import members_of, read_blocks
from ..sources.building import settings_of
from ..sources.sinks import drop_staging
from ..sources.tables import read
from .archives import _containers, _members

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

ROUNDS = 6  # of the stand-in containers; a plan's own default is 15


def _secrets(members: DataFrame) -> DataFrame:
    """Every third document is encrypted, by turns with one of two passwords."""
    i = F.col("member_index")
    return members.where(i % 3 == 0).select("archive", "member_index", F.when(i % 2 == 0, "even").otherwise("odd").alias("password"))


def _settings(spark, folder: str) -> DataFrame:
    """Title, time, lock and comment of each container follow from its number."""
    a = _members(spark, folder).select("archive").distinct().withColumn("k", F.expr("cast(substr(archive, 2) as long)"))
    return a.select("archive", F.when(F.col("k") % 2 == 0, F.encode(F.concat(F.lit("title "), "archive"), "UTF-8")).alias("title"), F.when(F.col("k") % 3 == 0, F.col("k") * 10_000_000 + 116_444_736_000_000_000).alias("created"), (F.col("k") % 5 == 0).alias("locked"), F.encode(F.concat(F.lit("about "), "archive"), "UTF-8").alias("comment"))


_SET = "SELECT DISTINCT 'a' || k AS archive, '5+' AS family, 'about a' || k AS comment, k % 5 = 0 AS locked, CASE WHEN k % 2 = 0 THEN 'title a' || k END AS title, CASE WHEN k % 3 = 0 THEN k * 10000000 + 116444736000000000 END AS created FROM (SELECT doc_id // 64 AS k FROM documents)"


def _shown(settings: DataFrame) -> DataFrame:
    return settings.select("archive", "family", F.decode("comment", "UTF-8").alias("comment"), "locked", F.decode("title", "UTF-8").alias("title"), "created")


def _path(containers: DataFrame) -> DataFrame:
    return containers.withColumnRenamed("archive", "path")


def _doc(name) -> F.Column:
    return F.regexp_extract(name, r"/(\d+)\.txt$", 1).cast("long").alias("doc_id")


@CATALOG.add("b01_new_builder", "SELECT 'p' || page_id AS path, 2 AS members, url AS comment FROM pages")
def b01(spark, folder):
    """A new plan: two members a page, and a comment for the container."""
    p = read(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("archive"), F.encode("url", "UTF-8").alias("comment"), F.encode("html", "UTF-8").alias("html"))
    rows = p.select("archive", F.posexplode(F.array(F.struct(F.lit(b"a.html").alias("name"), F.col("html").alias("payload")), F.struct(F.lit(b"b.txt").alias("name"), F.col("comment").alias("payload")))).alias("member_index", "x"))
    plan = ArchivePlan.new(spark).add(rows.select("archive", F.col("member_index").cast("long").alias("member_index"), "x.*")).set_archives(p.select("archive", "comment"))
    a = ArchiveFrame(_path(plan.build()))
    return a.test().where("damaged = 0").join(a.comment(), "path").select("path", "members", F.decode("comment", "UTF-8").alias("comment"))


@CATALOG.add("b09_preserving_builder", _SET)
def b09(spark, folder):
    """Containers with settings and encrypted members are rewritten without every fifth member: the settings stay."""
    m = _members(spark, folder)
    first = ArchivePlan(m).set_archives(_settings(spark, folder)).encrypt(m.where("member_index % 3 = 0").select("archive", "member_index", F.lit("secret").alias("password"))).build(ROUNDS)
    again = ArchiveFrame(_path(first), ReadOptions(password=b"secret")).preserving_plan()
    gone = again.members.where("member_index % 5 = 1").select("archive", "member_index")
    kept = again.members.join(gone, ["archive", "member_index"], "left_anti")
    return _shown(settings_of(_path(ArchivePlan(kept, settings=again.settings, secrets=again.secrets).build(ROUNDS))))


@CATALOG.add("b15_entry_encryption", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'BAD_PASSWORD' END AS code, CASE WHEN NOT (doc_id % 3 = 0 AND doc_id % 2 = 1) THEN sha256(text) END AS digest FROM documents")
def b15(spark, folder):
    """Members under two passwords; a reader that knows one of them reads its members and the open ones."""
    m = _members(spark, folder)
    a = ArchiveFrame(_path(ArchivePlan(m).encrypt(_secrets(m)).build(ROUNDS)), ReadOptions(password=b"even"))
    return a.read_many().select(_doc("name"), "code", F.sha2("payload", 256).alias("digest"))


@CATALOG.add("b16_archive_metadata", _SET)
def b16(spark, folder):
    return _shown(settings_of(_path(ArchivePlan(_members(spark, folder)).set_archives(_settings(spark, folder)).build())))


@CATALOG.add("v06_read_api", "SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents")
def v06(spark, folder):
    """Containers opened as a folder of files: the listing, and all members extracted under another folder."""
    source, out = scratch_folder(spark, "read-api"), scratch_folder(spark, "read-api-out")
    from ..sources.sinks import containers_to

    containers_to(_containers(spark, folder, "5+").withColumnRenamed("path", "archive"), source).write.format("noop").mode("overwrite").save()
    drop_staging(source)
    a = ArchiveFrame.open(spark, source)
    a.extractall(out).write.format("noop").mode("overwrite").save()
    drop_staging(out)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(_doc("path"), F.sha2("content", 256).alias("digest"))
    return a.infolist().select(_doc("name"), "size").join(files, "doc_id")


@CATALOG.add("v07_write_api", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 4 <> 2 UNION ALL SELECT 1000000000 + page_id, sha256(url) FROM pages")
def v07(spark, folder):
    """One plan: members removed, added, renamed and encrypted, with settings; read back with the password."""
    added = read(spark, folder, "pages").select(F.concat(F.lit("a"), F.expr("page_id div 64")).alias("archive"), (F.col("page_id").cast("long") + 1_000_000_000).alias("member_index"), F.encode(F.concat(F.lit("new/"), (F.col("page_id").cast("long") + 1_000_000_000).cast("string"), F.lit(".txt")), "UTF-8").alias("name"), F.encode("url", "UTF-8").alias("payload"))
    m = _members(spark, folder)
    renamed = m.where("member_index % 4 = 1").select("member_index", F.concat(F.lit(b"renamed/"), "name").alias("name"))
    plan = ArchivePlan(m).remove(m.where("member_index % 4 = 2").select("member_index")).edit(renamed, ["name"]).add(added).set_archives(_settings(spark, folder))
    plan = plan.encrypt(plan.members.where("member_index % 3 = 0").select("archive", "member_index", F.lit("secret").alias("password")))
    a = ArchiveFrame(_path(plan.build(ROUNDS)), ReadOptions(password=b"secret"))
    return a.read_many().where("code is null").select(_doc("name"), F.sha2("payload", 256).alias("digest"))


@CATALOG.add("v08_functions", "SELECT 'a' || doc_id // 64 AS path, true AS is_archive, (doc_id // 64) % 2 = 1 AS is_sfx, CASE WHEN (doc_id // 64) % 3 = 0 THEN 'undetermined' WHEN (doc_id // 64) % 3 = 1 THEN 'correct' ELSE 'wrong' END AS password_fits FROM documents GROUP BY ALL")
def v08(spark, folder):
    """Containers behind other bytes or not, open, or with headers encrypted under the asked password or another."""
    from ..functions import sealed

    @F.pandas_udf("binary")
    def make(path: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(path, content, strict=True):
            k, data = int(p[1:]), bytes(c)
            data = sealed.seal(data, b"asked" if k % 3 == 1 else b"other", k.to_bytes(16, "little"), 4) if k % 3 else data
            out.append(b"stub" * 20 + data if k % 2 else data)
        return pd.Series(out)

    return look(_containers(spark, folder, "5+").select("path", make("path", "content").alias("content")), b"asked")


@CATALOG.add(
    "v12_read_limits",
    """WITH m AS (SELECT 'a' || doc_id // 64 AS archive, octet_length(encode(text)) AS size, row_number() OVER w AS n, sum(octet_length(encode(text))) OVER w AS total FROM documents WINDOW w AS (PARTITION BY doc_id // 64 ORDER BY doc_id))
SELECT archive, count(*) AS members, count(*) FILTER (n + 1 > 40 OR size > 3000 OR total > 40000) AS refused FROM m GROUP BY archive""",
)
def v12(spark, folder):
    """Limits of headers, of a member's and of all members' output, each container for itself."""
    options = ReadOptions(max_header_count=40, max_member_output=3000, max_total_output=40000)
    b = members_of(with_codes(read_blocks(_containers(spark, folder, "5+"), payload=True), options))
    return b.groupBy(F.col("path").alias("archive")).agg(F.count("*").alias("members"), F.count_if(F.col("code") == CODES["resource_limit"]).alias("refused"))


@CATALOG.add("v13_error_codes", "SELECT page_id, (['UNSUPPORTED_FORMAT', 'INVALID_ARCHIVE', 'CHECKSUM_MISMATCH', 'CHECKSUM_MISMATCH', 'UNSAFE_ENTRY_NAME', 'PASSWORD_REQUIRED', NULL])[(page_id % 7 + 1)::INT] AS code FROM pages")
def v13(spark, folder):
    """A container a page: not one at all, cut, with a damaged header or payload, with an unsafe name, encrypted, and whole."""

    @F.pandas_udf("binary")
    def make(page: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for i, u in zip(page, url, strict=True):
            i, text = int(i) % 7, u.encode()
            data = A.write50([{"name": b"../up" if i == 4 else b"name", "payload": text, **({"encryption": bytes(47)} if i == 5 else {})}])
            at = data.rindex(text)
            out.append((text, data[:at], data.replace(b"name", b"nane"), data[:at] + bytes((text[0] ^ 1,)) + data[at + 1 :], data, data, data)[i])
        return pd.Series(out)

    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id", "url").alias("content"))
    found = ArchiveFrame(c).errors().groupBy("path").agg(F.min_by("code", "block").alias("code"))
    return c.select("path").join(found, "path", "left").select(F.col("path").cast("long").alias("page_id"), "code")
