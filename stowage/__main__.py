"""Commands: python -m stowage COMMAND PATH [MASK...] [--to FOLDER] [--password P] [--policy never|always|rename]

PATH is a file or a folder of containers that Spark can read. Long commands: info, list, test, extract, repair, errors.
Short ones, with the exit codes of their kind: l (list), lb (names alone), t (test), p (print), x (extract), e (extract without folders).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import selected
from .operators.repairs import repair_to
from .plans.facade import ArchiveError, ArchiveFrame, ReadOptions
from .sources.sinks import drop_staging, extract_to, plan_targets

# Exit codes
DONE, CHECKSUM, USAGE, NO_FILES, PASSWORD = 0, 3, 7, 10, 11
SHORT = {"l": "list", "t": "test", "x": "extract"}
COMMANDS = ("info", "list", "test", "extract", "repair", "errors", "l", "lb", "t", "p", "x", "e")


def _code(codes: set[str]) -> int:
    if codes & {"BAD_PASSWORD", "PASSWORD_REQUIRED"}:
        return PASSWORD
    return CHECKSUM if codes else DONE


def _printed(rows: DataFrame, out) -> int:
    """Rows as lines, fetched part by part; their number."""
    n = 0
    for r in rows.toLocalIterator():
        print(*("-" if v is None else v for v in r), sep="\t", file=out)
        n += 1
    return n


def _read(a: ArchiveFrame, masks: list[str]) -> DataFrame:
    m = a.read_many()
    return m.where(selected(F.col("name"), masks)) if masks else m


def run(spark: SparkSession, arguments: list[str], out=sys.stdout) -> int:
    """The exit code; reports go to `out` a row a line."""
    parser = argparse.ArgumentParser(prog="stowage", description=__doc__, exit_on_error=False)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("path")
    parser.add_argument("masks", nargs="*")
    parser.add_argument("--to", default=".")
    parser.add_argument("--password")
    parser.add_argument("--policy", choices=("never", "always", "rename"), default="never")
    try:
        a = parser.parse_args(arguments)
    except (argparse.ArgumentError, SystemExit):
        return USAGE
    frame = ArchiveFrame.open(spark, a.path, ReadOptions(password=a.password.encode() if a.password else None))
    command = SHORT.get(a.command, a.command)
    info = frame.infolist()
    info = info.where(selected(F.col("name"), a.masks)) if a.masks else info
    if command == "info":
        _printed(info.groupBy("path", "family").agg(F.count("*"), F.sum("size"), F.sum("packed"), F.bool_or("is_encrypted")).orderBy("path"), out)
    elif command == "list":
        return DONE if _printed(info.select("path", "name", "size", "packed", F.lpad(F.lower(F.hex("check_value")), 8, "0")).orderBy("path", "member_index"), out) else NO_FILES
    elif command == "lb":
        return DONE if _printed(info.orderBy("path", "member_index").select("name"), out) else NO_FILES
    elif command == "errors":
        return _code({r.code for r in frame.errors().select("code").distinct().collect()})
    elif command == "test":
        counts = _read(frame, a.masks).groupBy("code").count().collect()
        for r in counts:
            print(r.code or "OK", r["count"], sep="\t", file=out)
        return _code({r.code for r in counts if r.code}) if counts else NO_FILES
    elif command == "p":
        n, codes = 0, set()
        for r in _read(frame, a.masks).orderBy("path", "member_index").toLocalIterator():
            n += 1
            if r.code:
                codes.add(r.code)
            else:
                out.write(bytes(r.payload).decode("utf-8", "replace"))
        return _code(codes) if n else NO_FILES
    elif command in ("extract", "e"):
        os.makedirs(a.to, exist_ok=True)
        m = _read(frame, a.masks).withColumn("name", F.encode("name", "UTF-8")).withColumn("payload_ok", F.col("code").isNull())
        counts = {r.status: r["count"] for r in extract_to(plan_targets(m, a.policy, a.command == "e"), a.to, a.policy).groupBy("status").count().collect()}
        drop_staging(a.to)
        for k in sorted(counts):
            print(k, counts[k], sep="\t", file=out)
        if "damaged" not in counts:
            return DONE if counts else NO_FILES
        return _code({r.code for r in _read(frame, a.masks).where("code is not null").select("code").distinct().collect()})
    elif command == "repair":
        os.makedirs(a.to, exist_ok=True)
        source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.path).select("path", "content")
        counts = {r.status: r["count"] for r in repair_to(source, a.to).groupBy("status").count().collect()}
        drop_staging(a.to)
        for k in sorted(counts):
            print(k, counts[k], sep="\t", file=out)
        return CHECKSUM if "unrepaired" in counts else DONE if counts else NO_FILES
    return DONE


def main() -> int:
    spark = SparkSession.builder.appName("stowage").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except ArchiveError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
