"""Containers from plans: settings of containers and encrypted members, written and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ciphers, extras
from ..functions import formats as A

# Record types of a member's encryption and link, and of a container's metadata
ENCRYPTION, LINK, METADATA = 1, 5, 2


def _record(kind: int):
    return F.get(F.filter("extras", lambda e: e["type"] == kind), 0)["data"]


# ------------------------------------------------------------------ encrypted members
def _keys(password, salt, log_rounds):
    @F.pandas_udf("struct<key:binary,record:binary>")
    def derive(password: pd.Series, salt: pd.Series, log_rounds: pd.Series) -> pd.DataFrame:
        out = []
        for p, s, n in zip(password, salt, log_rounds, strict=True):
            k = ciphers.keys50(bytes(p), bytes(s), int(n))
            out.append({"key": k["key"], "record": ciphers.check_record(k["check"])})
        return pd.DataFrame(out, columns=["key", "record"])

    return derive(password, salt, log_rounds)


def encrypted(members: DataFrame, secrets: DataFrame, log_rounds: int = 15) -> DataFrame:
    """Members with `encryption` (the record), `unpacked` and `crc` of the plain bytes, and payloads sealed where there is a secret.

    One salt and one derivation for each container and password; vectors follow from the member's place and bytes, so reruns agree.
    Sealing is done by built-in functions.
    """
    m = members.join(secrets, ["archive", "member_index"], "left")
    salts = secrets.select("archive", "password").distinct().withColumn("salt", F.unhex(F.substr(F.sha2(F.concat_ws("\0", "archive", F.hex("password")), 256), F.lit(1), F.lit(32))))
    keys = salts.withColumn("k", _keys("password", "salt", F.lit(log_rounds))).select("archive", "password", "salt", "k.*")
    m = m.join(keys, ["archive", "password"], "left")
    iv = F.unhex(F.md5(F.concat(F.encode(F.concat_ws("\0", "archive", F.col("member_index").cast("string"), F.hex("salt")), "UTF-8"), F.coalesce("payload", F.lit(b"")))))
    size = F.length("payload")
    filled = F.concat("payload", F.substr(F.lit(bytes(16)), F.lit(1), (16 - size % 16) % 16))
    has = F.col("key").isNotNull() & F.col("payload").isNotNull()
    m = m.withColumn("iv", iv)
    head = F.lit(bytes((0, 1, log_rounds)))  # version, flags: a check of the password follows, and the rounds
    return m.select(
        *(c for c in members.columns if c != "payload"),
        F.when(has, F.when(size > 0, ciphers.aes_encrypt_raw(filled, F.col("key"), F.col("iv"))).otherwise(F.lit(b""))).otherwise(F.col("payload")).alias("payload"),
        F.when(has, F.concat(head, F.col("salt"), F.col("iv"), F.col("record"))).alias("encryption"),
        F.when(has, size.cast("long")).alias("unpacked"),
        F.when(has, F.crc32("payload")).alias("crc"),
    )


def opened(members: DataFrame, password: bytes, bad: str, mismatch: str, unsupported: str) -> DataFrame:
    """Members with the payloads of encrypted ones opened; `code` says where the password is wrong, the check value differs, or the record is of another kind.

    One derivation for each salt. Check values that are keyed themselves (flag 2) are not compared.
    """
    m = members.withColumn("_e", F.when(F.col("is_encrypted") & F.col("code").isNull(), _record(ENCRYPTION)))
    known = F.col("_e").isNotNull() & (F.length("_e") >= 35) & (F.substr("_e", F.lit(1), F.lit(1)) == F.lit(b"\0"))
    m = m.withColumn("_salt", F.when(known, F.substr("_e", F.lit(4), F.lit(16)))).withColumn("_rounds", F.when(known, F.conv(F.hex(F.substr("_e", F.lit(3), F.lit(1))), 16, 10).cast("int")))
    m = m.withColumn("_salt", F.when(F.col("_rounds") <= 24, F.col("_salt")))
    keys = m.where("_salt is not null").select("_salt", "_rounds").distinct().withColumn("_k", _keys(F.lit(password), "_salt", "_rounds"))
    j = m.join(keys, ["_salt", "_rounds"], "left")
    flags = F.conv(F.hex(F.substr("_e", F.lit(2), F.lit(1))), 16, 10).cast("int")
    stored = F.substr("_e", F.lit(36), F.lit(12))
    wrong = (flags.bitwiseAND(1) == 1) & (stored != F.col("_k.record")) & (F.substr(stored, F.lit(1), F.lit(8)) != F.lit(bytes(8)))
    whole = (F.length("payload") % 16 == 0) & (F.length("payload") >= F.col("unpacked"))
    plain = F.when(F.length("payload") == 0, F.lit(b"")).otherwise(F.substr(ciphers.aes_decrypt_raw(F.col("payload"), F.col("_k.key"), F.substr("_e", F.lit(20), F.lit(16))), F.lit(1), F.col("unpacked").cast("int")))
    sealed = F.col("is_encrypted") & F.col("code").isNull()
    j = j.withColumn("_code", F.when(sealed & F.col("_k").isNull(), unsupported).when(sealed & wrong, bad).when(sealed & ~whole, mismatch))
    j = j.withColumn("_plain", F.when(sealed & F.col("_code").isNull(), plain))
    differs = (flags.bitwiseAND(2) == 0) & (F.crc32("_plain") != F.col("check_value"))
    j = j.withColumn("_code", F.coalesce("_code", F.when(F.col("_plain").isNotNull() & differs, mismatch)))
    return j.select(*(F.coalesce("_plain", "payload").alias(c) if c == "payload" else F.coalesce("code", "_code").alias(c) if c == "code" else c for c in members.columns))


# ------------------------------------------------------------------ settings
_SETTINGS = "archive string, family string, comment binary, locked boolean, title binary, created long"


def settings_of(containers: DataFrame) -> DataFrame:
    """archive, family, comment, locked, title, created of containers (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                data = bytes(content or b"")
                x = {"archive": path, "family": None, "comment": None, "locked": False, "title": None, "created": None}
                for b in A.parse(data):
                    if b["kind"] == "none":
                        break
                    x["family"] = b["family"]
                    if b["family"] == "5+" and b["kind"] == "main" and b["header_ok"]:
                        x["locked"] = bool(b["attr"] & 16)
                        for e in b["extras"]:
                            if e["type"] == METADATA:
                                found = extras.read_metadata(e["data"])
                                x["title"], x["created"] = found["name"], found["ticks"]
                    if b["kind"] == "service" and b["name"] == b"CMT":
                        piece = data[b["data_offset"] : b["data_offset"] + b["packed"]]
                        x["comment"] = piece if b["method"] == 0 and A.payload_ok(b, piece) else None
                rows.append(tuple(x.values()))
            yield pd.DataFrame(rows, columns=["archive", "family", "comment", "locked", "title", "created"]).astype({"created": "Int64"})

    return containers.select("path", "content").mapInPandas(run, _SETTINGS)


def comments_of(containers: DataFrame) -> DataFrame:
    return settings_of(containers).where("comment is not null").select(F.col("archive").alias("path"), "comment")


def link_targets(members: DataFrame) -> DataFrame:
    """path, member_index, name, link_target: the record of format 5+, or the payload of Unix links of formats 1.5 to 4."""

    @F.pandas_udf("string")
    def target(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            if d is None:
                out.append(None)
                continue
            _, at = A.read_vint(d, 0)
            _, at = A.read_vint(d, at)
            n, at = A.read_vint(d, at)
            out.append(bytes(d[at : at + n]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    old = (F.col("family") == "1.5-4") & (F.col("host") == 3) & (F.col("attr").bitwiseAND(0xF000) == 0xA000)
    m = members.withColumn("_link", _record(LINK)).withColumn("_old", old).where(F.col("_link").isNotNull() | F.col("_old"))
    return m.select("path", "member_index", F.decode("name", "UTF-8").alias("name"), F.coalesce(target("_link"), F.when(F.col("_old"), F.decode("payload", "UTF-8"))).alias("link_target"))


def write_planned(members: DataFrame, settings: DataFrame | None = None, family: str = "5+") -> DataFrame:
    """(archive, content): an archive's members meet in one task, with its settings where there are any; an archive with settings alone is empty."""
    writers = {"5+": A.write50, "1.5-4": A.write15, "1.3": A.write13}
    sealed = "encryption" in members.columns

    def build(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x = own.iloc[0] if len(own) else {}
        kind = x.get("family") or family
        ms = []
        for r in pdf.sort_values("member_index").itertuples():
            m = {"name": bytes(r.name), "payload": bytes(r.payload or b"")}
            if sealed and r.encryption is not None:
                if kind != "5+":
                    raise ValueError("only format 5+ encrypts members here")
                m |= {"encryption": bytes(r.encryption), "unpacked": int(r.unpacked), "crc": int(r.crc)}
            ms.append(m)
        more = {}
        if kind == "5+":
            title, created = x.get("title"), x.get("created")
            created = None if created is None or pd.isna(created) else int(created)
            more = {"comment": x.get("comment"), "locked": bool(x.get("locked")), "metadata": extras.write_metadata(title, created) if title is not None or created is not None else None}
        return pd.DataFrame({"archive": [key[0]], "content": [writers[kind](ms, **more)]})

    m = members.select("archive", "member_index", "name", "payload", *(["encryption", "unpacked", "crc"] if sealed else []))
    if settings is None:
        return m.groupBy("archive").applyInPandas(lambda key, pdf: build(key, pdf, pd.DataFrame()), "archive string, content binary")
    return m.groupBy("archive").cogroup(settings.groupBy("archive")).applyInPandas(build, "archive string, content binary")
