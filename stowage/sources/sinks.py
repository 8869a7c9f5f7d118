"""Members to files: staged, verified, then renamed into place, with a report row for each.

The folder must be one that all executors share (a mounted path). A payload is written under a staging folder,
checked, and linked or renamed into place, so readers see whole files only. The staged file stays until
`drop_staging`: by it, a retried task knows the files that its first attempt put in place. A file that was there
before stays with 'never', is replaced with 'always', and with 'rename' the new one gets a free number.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import flat_name, numbered, relative_path

POLICIES = ("never", "always", "rename")
REPORT = "path string, target string, status string, bytes long"


def plan_targets(members: DataFrame, policy: str = "never", flat: bool = False) -> DataFrame:
    """`target` of each member (path, member_index, name): safe relative path; later claimants of one path are refused ('never'),
    win ('always') or get a number ('rename'); of flat names a second claimant is always refused. Unsafe names have no target."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    text = relative_path(F.decode("name", "UTF-8"), backslash=True)
    m = members.withColumn("target", flat_name(text) if flat else text)
    order = F.col("member_index").desc() if policy == "always" and not flat else F.col("member_index")
    m = m.withColumn("claim", F.row_number().over(Window.partitionBy("target", F.when(F.col("target").isNull(), F.xxhash64("path", "member_index"))).orderBy("path" if not (policy == "always" and not flat) else F.desc("path"), order)))
    first = F.col("claim") == 1
    if policy == "rename" and not flat:
        return m.withColumn("target", F.when(first, F.col("target")).otherwise(numbered(F.col("target"), F.col("claim") - 1))).drop("claim")
    return m.withColumn("target", F.when(first, F.col("target"))).drop("claim")


def publish(payload: bytes, root: str, staging: str, path: str, target: str, policy: str) -> str | None:
    """Puts a payload in place under its target or, with 'rename', a numbered one; the target, or None if it is taken."""
    os.makedirs(staging, exist_ok=True)
    part = os.path.join(staging, hashlib.sha256(f"{path}\0{target}".encode("utf-8", "surrogateescape")).hexdigest())
    if not os.path.exists(part):
        own = f"{part}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(payload)
        os.replace(own, part)
    for k in range(1 << 16):
        stem, dot, end = target.rpartition(".")
        name = target if not k else f"{stem}({k}).{end}" if dot and "/" not in end else f"{target}({k})"
        final = os.path.join(root, name)
        os.makedirs(os.path.dirname(final), exist_ok=True)
        try:
            os.link(part, final)
            return name
        except FileExistsError:
            if os.path.samefile(part, final) if os.path.exists(final) else False:
                return name  # an earlier attempt of this task
            if policy == "always":
                again = f"{part}.{uuid.uuid4().hex}"
                os.link(part, again)
                os.replace(again, final)
                return name
            if policy == "never":
                return None
    raise OSError(f"no free number for {target}")


def safe_join(root: str, relative: str) -> str | None:
    """The place of a relative path under a real root; None where it leaves the root or goes through a link that is there."""
    final = os.path.normpath(os.path.join(root, relative))
    if final == root or not final.startswith(root + os.sep):
        return None
    at = os.path.dirname(final)
    while at != root:
        if os.path.islink(at):
            return None
        at = os.path.dirname(at)
    return final


def write_in_place(payload: bytes, final: str, policy: str) -> bool:
    """Straight into the file: what was written stays if the task is lost, and a retry starts it anew. False if it is there and stays."""
    os.makedirs(os.path.dirname(final), exist_ok=True)
    if policy == "never" and os.path.lexists(final):
        return False
    if os.path.islink(final):
        os.unlink(final)
    with open(final, "wb") as f:
        f.write(payload)
    return True


def extract_to(members: DataFrame, folder: str, policy: str = "never", in_place: bool = False) -> DataFrame:
    """Report of writing members (path, target, payload, payload_ok) under a folder: written, refused, damaged, exists or unsafe.

    Nothing is written until an action runs on the report. `in_place` leaves out staging ('never' and 'always' only): damaged
    payloads are written as far as they go and reported so, and with 'never' a retried task reports its own files as there.
    """
    if in_place and policy == "rename":
        raise ValueError("numbers need staging")
    run_id = uuid.uuid4().hex

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = os.path.realpath(folder)
        staging = os.path.join(root, f".staging-{run_id}")
        for pdf in batches:
            rows = []
            for path, target, payload, ok in zip(pdf.path, pdf.target, pdf.payload, pdf.payload_ok, strict=True):
                if target is None:
                    rows.append((path, None, "refused", 0))
                    continue
                final = safe_join(root, target)
                if final is None:
                    rows.append((path, target, "unsafe", 0))
                elif in_place:
                    done = write_in_place(payload, final, policy)
                    rows.append((path, target, "exists" if not done else "written" if ok else "damaged", len(payload) if done else 0))
                elif not ok:
                    rows.append((path, target, "damaged", 0))
                else:
                    got = publish(payload, root, staging, path, target, policy)
                    rows.append((path, got or target, "written" if got else "exists", len(payload) if got else 0))
            yield pd.DataFrame(rows, columns=["path", "target", "status", "bytes"])

    return members.select("path", "target", "payload", "payload_ok").mapInPandas(write, REPORT)


def extract_with(members: DataFrame, opener) -> DataFrame:
    """Every member (path, member_index, name, payload, payload_ok) through a caller's writer, in archive order within a path:
    `opener(path, member_index, name)` gives an object with write and close, or None to skip. One report row a member.

    `opener` runs on executors. A path is written by one task; a retry writes it again from its first member.
    """
    step = 1 << 16

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, index, name, payload, ok in zip(pdf.path, pdf.member_index, pdf.name, pdf.payload, pdf.payload_ok, strict=True):
                if not ok:
                    rows.append((path, index, "damaged", 0))
                elif (out := opener(path, int(index), bytes(name))) is None:
                    rows.append((path, index, "skipped", 0))
                else:
                    data = bytes(payload)
                    for at in range(0, len(data), step):
                        out.write(data[at : at + step])
                    out.close()
                    rows.append((path, index, "written", len(data)))
            yield pd.DataFrame(rows, columns=["path", "member_index", "status", "bytes"])

    ordered = members.select("path", "member_index", "name", "payload", "payload_ok").repartition("path").sortWithinPartitions("path", "member_index")
    return ordered.mapInPandas(write, "path string, member_index long, status string, bytes long")


def selected_by(members: DataFrame, decide: Callable[[dict], bool], columns: list[str]) -> DataFrame:
    """Members for which a caller's function of the named columns is true. A condition on columns is the better way where there is one."""

    @F.pandas_udf("boolean")
    def chosen(x: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(decide(r)) for r in x.to_dict("records")], dtype=bool)

    return members.where(chosen(F.struct(*columns)))


def on_error(members: DataFrame, handler: Callable[[str, int, str], str]) -> DataFrame:
    """Members (path, member_index, code) without those refused: for each with a code, a caller's function says 'skip' (it is left out) or 'stop'
    (and so are all that follow in its container). The function is asked once for each refused member, in any order."""

    @F.pandas_udf("string")
    def ask(path: pd.Series, index: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else handler(p, int(i), c) for p, i, c in zip(path, index, code, strict=True)], dtype=object)

    m = members.withColumn("_said", ask("path", "member_index", "code"))
    ends = m.where("_said = 'stop'").groupBy("path").agg(F.min("member_index").alias("_end"))
    return m.where("code is null").join(ends, "path", "left").where("_end is null or member_index < _end").drop("_said", "_end")


def progress(members: DataFrame) -> DataFrame:
    """Members with `completed` (bytes of their container up to them) and `total`."""
    from ..operators.running import running

    totals = members.groupBy("path").agg(F.sum("packed").alias("total"))
    return running(members, ["path"], "member_index", {"completed": F.col("packed")}).join(totals, "path")


LINKS = ("symlink", "hard link", "copy")


def make_link(root: str, target: str, kind: str, to: str, policy: str = "never") -> str:
    """A symlink, hard link or copy under a root: written, exists, unsafe (a place or an end outside the root) or missing (nothing to link or copy).

    The end of a symlink is relative to the link's folder, that of the others to the root. A link of a retried task counts as written.
    """
    final = safe_join(root, target)
    end = None if os.path.isabs(to) else safe_join(root, os.path.join(os.path.dirname(target), to) if kind == "symlink" else to)
    if final is None or end is None or kind not in LINKS:
        return "unsafe"
    if kind != "symlink" and (os.path.islink(end) or not os.path.isfile(end)):
        return "missing"
    os.makedirs(os.path.dirname(final), exist_ok=True)
    if os.path.lexists(final) and policy == "never":
        ours = os.readlink(final) == to if os.path.islink(final) and kind == "symlink" else kind == "hard link" and not os.path.islink(final) and os.path.samefile(final, end)
        return "written" if ours else "exists"
    own = f"{final}.{uuid.uuid4().hex}"
    if kind == "symlink":
        os.symlink(to, own)
    elif kind == "hard link":
        os.link(end, own)
    else:
        shutil.copyfile(end, own)
    os.replace(own, final)
    if os.path.lexists(own):  # both names were one file already
        os.unlink(own)
    return "written"


def links_to(links: DataFrame, folder: str, policy: str = "never") -> DataFrame:
    """Report (path, target, status) of making links (path, target, kind, link_target) under a folder whose files are there."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = os.path.realpath(folder)
        for pdf in batches:
            rows = [(p, t, "refused" if t is None or to is None else make_link(root, t, k, to, policy)) for p, t, k, to in zip(pdf.path, pdf.target, pdf.kind, pdf.link_target, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "target", "status"])

    return links.select("path", "target", "kind", "link_target").mapInPandas(write, "path string, target string, status string")


class VolumeFolder:
    """Where volumes go: `expect` is told how many a set has, then `write` gets each in order; here, whole files of a shared folder."""

    def __init__(self, folder: str, pattern: str = "{set_id}.part{number}.rar") -> None:
        self.folder, self.pattern, self.count = folder, pattern, 1

    def expect(self, set_id, volumes: int) -> None:
        self.count = volumes

    def place(self, set_id, index: int) -> str:
        return os.path.join(self.folder, self.pattern.format(set_id=set_id, number=str(index + 1).zfill(len(str(self.count)))))

    def write(self, set_id, index: int, content: bytes) -> None:
        final = self.place(set_id, index)
        own = f"{final}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(content)
        os.replace(own, final)


def volumes_to(volumes: DataFrame, sink: VolumeFolder) -> DataFrame:
    """Report (set_id, volume, bytes) of giving volumes (set_id, volume, content) to a sink, in order within a set."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for set_id, volume, count, content in zip(pdf.set_id, pdf.volume, pdf["count"], pdf.content, strict=True):
                sink.expect(set_id, int(count))
                sink.write(set_id, int(volume), bytes(content))
            yield pd.DataFrame({"set_id": pdf.set_id, "volume": pdf.volume, "bytes": [len(c) for c in pdf.content]})

    counted = volumes.repartition("set_id").withColumn("count", F.count("*").over(Window.partitionBy("set_id")))
    ordered = counted.select("set_id", "volume", "count", "content").sortWithinPartitions("set_id", "volume")
    return ordered.mapInPandas(write, "set_id long, volume int, bytes long")


def containers_to(containers: DataFrame, folder: str, policy: str = "never") -> DataFrame:
    """Report (path, target, status, bytes) of publishing containers (archive, content) as whole files under a folder."""
    m = containers.select(F.col("archive").alias("path"), F.concat("archive", F.lit(".rar")).alias("target"), F.col("content").alias("payload"), F.lit(True).alias("payload_ok"))
    return extract_to(m, folder, policy)


def drop_staging(folder: str) -> None:
    """Removes staging folders after the report was read."""
    for name in os.listdir(folder):
        if name.startswith(".staging-"):
            shutil.rmtree(os.path.join(folder, name))
