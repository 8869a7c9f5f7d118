"""An archive as an object: listing, lookup, reading, testing and rewriting over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_empty_path, is_unsafe, selected
from ..operators.rewrite import delete, insert, update
from ..operators.running import running
from ..sources.archives import members_of, read_blocks, read_files
from ..sources.building import comments_of, encrypted, link_targets, opened, settings_of, write_planned
from ..sources.sinks import extract_to, plan_targets

#: The kinds of errors and their stable codes.
CODES = {
    "invalid_archive": "INVALID_ARCHIVE",
    "invalid_argument": "INVALID_OPTION",
    "unsupported_format": "UNSUPPORTED_FORMAT",
    "unsupported_feature": "UNSUPPORTED_FEATURE",
    "password_required": "PASSWORD_REQUIRED",
    "bad_password": "BAD_PASSWORD",
    "checksum_mismatch": "CHECKSUM_MISMATCH",
    "entry_not_found": "ENTRY_NOT_FOUND",
    "duplicate_entry": "DUPLICATE_ENTRY",
    "unsafe_path": "UNSAFE_ENTRY_NAME",
    "io": "IO",
    "resource_limit": "RESOURCE_LIMIT",
    "cancelled": "CANCELLED",
    "source_changed": "SOURCE_CHANGED",
    "writer_failure": "WRITE_FAILED",
}


class ArchiveError(Exception):
    """kind is a key of CODES; `code` is what programs compare."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind, self.code = kind, CODES[kind]


@dataclass(frozen=True)
class ReadOptions:
    """What a reader admits, each container for itself; None: no limit. Limits are inclusive."""

    password: bytes | None = None
    max_header_count: int | None = None
    max_header_bytes: int | None = None
    max_member_output: int | None = None
    max_total_output: int | None = None

    def __post_init__(self) -> None:
        if any(v is not None and v < 0 for v in (self.max_header_count, self.max_header_bytes, self.max_member_output, self.max_total_output)):
            raise ArchiveError("invalid_argument", "a limit is negative")


def with_codes(blocks: DataFrame, options: ReadOptions) -> DataFrame:
    """Blocks (with `payload_ok`) and the column `code`: why a reader with these options refuses a block, null where it does not."""
    b = blocks.withColumn("block", F.coalesce("block", F.lit(0)))
    is_file = F.col("kind") == "file"
    b = running(b, ["path"], "block", {"_headers": F.lit(1), "_bytes": F.coalesce(F.col("data_offset") - F.col("offset"), F.lit(0)), "_output": F.when(is_file, F.coalesce("unpacked", F.lit(0))).otherwise(0)})

    def above(column: str, most: int | None):
        return F.lit(False) if most is None else F.col(column) > most

    text = F.decode("name", "UTF-8")
    code = (
        F.when(F.col("kind") == "none", CODES["unsupported_format"])
        .when(above("_headers", options.max_header_count) | above("_bytes", options.max_header_bytes), CODES["resource_limit"])
        .when((F.col("kind") == "cut") | F.col("error").isNotNull(), CODES["invalid_archive"])
        .when(~F.col("header_ok"), CODES["checksum_mismatch"])
        .when(is_file & (above("unpacked", options.max_member_output) | above("_output", options.max_total_output)), CODES["resource_limit"])
        .when(is_file & (is_unsafe(text) | is_empty_path(text)), CODES["unsafe_path"])
        .when(is_file & F.col("is_encrypted") & F.lit(options.password is None), CODES["password_required"])
        .when(is_file & ~F.col("is_encrypted") & ~F.col("payload_ok"), CODES["checksum_mismatch"])
    )
    return b.withColumn("code", code).drop("_headers", "_bytes", "_output")


class ArchiveFrame:
    """Containers under a path, or rows (path, content). Payload bytes are read only by the methods that return them."""

    def __init__(self, source: DataFrame, options: ReadOptions = ReadOptions()) -> None:
        self._source, self._options = source, options

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> ArchiveFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return cls(files.select("path", "content"), options)

    def blocks(self) -> DataFrame:
        return read_blocks(self._source)

    def members(self) -> DataFrame:
        return members_of(self.blocks())

    def namelist(self) -> DataFrame:
        return self.members().select("path", "member_index", F.decode("name", "UTF-8").alias("name"))

    def select(self, masks: list[str]) -> DataFrame:
        return self.members().where(selected(F.decode("name", "UTF-8"), masks))

    def read(self, name: bytes) -> DataFrame:
        """path, payload of the last member of that name with a payload in each container."""
        m = members_of(read_blocks(self._source, payload=True)).where((F.col("name") == F.lit(name)) & ~F.col("is_directory"))
        return m.groupBy("path").agg(F.max_by("payload", "member_index").alias("payload"))

    def infolist(self) -> DataFrame:
        """path, member_index, name, size, packed, check_value, time, host, attr, is_directory, is_encrypted, is_solid, family."""
        m = self.members()
        return m.select("path", "member_index", F.decode("name", "UTF-8").alias("name"), F.col("unpacked").alias("size"), "packed", "check_value", "time", "host", "attr", "is_directory", "is_encrypted", "is_solid", "family")

    def getinfo(self, name: str) -> DataFrame:
        """The last entry of that name in each container."""
        i = self.infolist().where(F.col("name") == name)
        return i.groupBy("path").agg(F.max_by(F.struct(*(c for c in i.columns if c != "path")), "member_index").alias("x")).select("path", "x.*")

    def read_many(self, names: DataFrame | None = None) -> DataFrame:
        """path, member_index, name, payload, code of all members, or of those in `names` (name); encrypted ones are opened with the password of the
        options. A member that the options refuse has a code and no payload."""
        m = members_of(with_codes(read_blocks(self._source, payload=True), self._options)).withColumn("name", F.decode("name", "UTF-8"))
        if names is not None:
            m = m.join(names.select("name").distinct(), "name", "left_semi")
        if self._options.password is not None:
            m = opened(m, self._options.password, CODES["bad_password"], CODES["checksum_mismatch"], CODES["unsupported_feature"])
        return m.select("path", "member_index", "name", F.when(F.col("code").isNull(), F.col("payload")).alias("payload"), "code")

    def errors(self) -> DataFrame:
        """path, block, code of what a reader with these options refuses."""
        return with_codes(read_blocks(self._source, payload=True), self._options).where("code is not null").select("path", "block", "code")

    def comment(self) -> DataFrame:
        """path, comment of the containers that have one (format 5+)."""
        return comments_of(self._source)

    def readlink(self) -> DataFrame:
        """path, member_index, name, link_target of the members that are links."""
        return link_targets(members_of(read_blocks(self._source, payload=True)))

    def needs_password(self) -> DataFrame:
        return self.blocks().groupBy("path").agg(F.coalesce(F.bool_or(F.coalesce("is_encrypted", F.lit(False)) | (F.col("kind") == "crypt")), F.lit(False)).alias("needs_password"))

    def extractall(self, folder: str, policy: str = "never") -> DataFrame:
        """Report of extracting every admitted member under a shared folder; nothing is written until an action runs on it."""
        m = self.read_many().withColumn("name", F.encode("name", "UTF-8")).withColumn("payload_ok", F.col("code").isNull())
        return extract_to(plan_targets(m, policy), folder, policy)

    def test(self) -> DataFrame:
        """path, members, damaged: verdicts without the bytes."""
        m = members_of(read_blocks(self._source, payload=True))
        return m.groupBy("path").agg(F.count("*").alias("members"), F.count_if(~(F.col("payload_ok") & F.col("header_ok"))).alias("damaged"))

    def is_archive(self) -> DataFrame:
        return self.blocks().groupBy("path").agg(F.bool_and(F.col("kind") != "none").alias("is_archive"))

    def plan(self) -> ArchivePlan:
        m = members_of(read_blocks(self._source, payload=True))
        return ArchivePlan(m.select(F.col("path").alias("archive"), "member_index", "name", "payload"))

    def preserving_plan(self) -> ArchivePlan:
        """A plan that keeps each container's family, comment, lock and metadata. Encrypted members are opened with the password of the options
        and sealed with it again; containers with errors are left out, since a rewrite would lose something (see `errors`)."""
        good = self.read_many()
        bad = good.where("code is not null").select("path").distinct()
        m = good.join(bad, "path", "left_anti")
        members = m.select(F.col("path").alias("archive"), "member_index", F.encode("name", "UTF-8").alias("name"), "payload")
        kept = settings_of(self._source).join(bad.withColumnRenamed("path", "archive"), "archive", "left_anti")
        plan = ArchivePlan(members, settings=kept)
        if self._options.password is None:
            return plan
        sealed = self.members().where("is_encrypted").select(F.col("path").alias("archive"), "member_index", F.lit(self._options.password).alias("password"))
        return plan.encrypt(sealed)


@dataclass(frozen=True)
class ArchivePlan:
    """What to write: an immutable plan over a members DataFrame (archive, member_index, name, payload).

    `settings` (archive, family, comment, locked, title, created) are of containers, `secrets` (archive, member_index, password) of members.
    """

    members: DataFrame
    family: str = "5+"
    settings: DataFrame | None = None
    secrets: DataFrame | None = None

    @classmethod
    def new(cls, spark: SparkSession, family: str = "5+") -> ArchivePlan:
        """An empty plan."""
        if family not in FAMILIES:
            raise ArchiveError("invalid_argument", f"family is one of {FAMILIES}")
        return cls(spark.createDataFrame([], "archive string, member_index long, name binary, payload binary"), family)

    def set_archives(self, settings: DataFrame) -> ArchivePlan:
        """Comment, lock, title and creation time (ticks of 100 ns since 1601) of containers; columns that are left out are null, and formats before 5 take none of them."""
        have = settings.columns
        kinds = {"family": "string", "comment": "binary", "locked": "boolean", "title": "binary", "created": "long"}
        return replace(self, settings=settings.select("archive", *((F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in kinds.items())))

    def encrypt(self, secrets: DataFrame) -> ArchivePlan:
        """Members to encrypt (archive, member_index, password), in format 5+."""
        return replace(self, secrets=secrets.select("archive", "member_index", F.col("password").cast("binary").alias("password")))

    def add(self, new: DataFrame) -> ArchivePlan:
        return replace(self, members=insert(self.members, new))

    def remove(self, ids: DataFrame) -> ArchivePlan:
        return replace(self, members=delete(self.members, ids))

    def edit(self, edits: DataFrame, columns: list[str]) -> ArchivePlan:
        return replace(self, members=update(self.members, edits, columns))

    def problems(self) -> DataFrame:
        """Members whose name the writer refuses, and names that an archive holds twice."""
        text = F.decode("name", "UTF-8")
        unsafe = self.members.where(is_unsafe(text) | is_empty_path(text)).select("archive", "name", F.lit("unsafe_path").alias("kind"))
        twice = self.members.groupBy("archive", "name").agg(F.count("*").alias("n")).where("n > 1").select("archive", "name", F.lit("ambiguous").alias("kind"))
        return unsafe.unionByName(twice)

    def build(self, log_rounds: int = 15) -> DataFrame:
        """archive, content."""
        members = self.members if self.secrets is None else encrypted(self.members, self.secrets, log_rounds)
        return write_planned(members, self.settings, self.family)


FAMILIES = ("5+", "1.5-4", "1.3")


def look(containers: DataFrame, password: bytes | None = None) -> DataFrame:
    """path, is_archive, is_sfx (a signature behind other bytes), password_fits (correct, wrong or undetermined) of containers (path, content)."""
    from ..functions import formats, sealed

    @F.pandas_udf("struct<is_archive:boolean,is_sfx:boolean,password_fits:string>")
    def one(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            data = bytes(c or b"")
            found = formats.find_signature(data)
            fits = sealed.matches(data[found[1] :], password) if found and password is not None else "undetermined"
            out.append({"is_archive": found is not None, "is_sfx": found is not None and found[1] > 0, "password_fits": fits})
        return pd.DataFrame(out, columns=["is_archive", "is_sfx", "password_fits"])

    return containers.select("path", one("content").alias("x")).select("path", "x.*")


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path)
