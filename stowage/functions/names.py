"""Column functions for member names, paths, volume names and labels.

Names are text columns here; rules are about ASCII syntax, so they hold for any encoding of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats
VERSIONS = {"rar13": "1.3", "rar14": "1.3", "rar15": "1.5-4", "rar20": "1.5-4", "rar29": "1.5-4", "rar30": "1.5-4", "rar40": "1.5-4", "rar50": "5+", "rar70": "5+"}
SHORT_VERSIONS = {"rar4": "rar40", "rar5": "rar50", "rar7": "rar70"}
ENCODINGS = {"cp437": "cp437", "cp850": "cp850", "cp852": "cp852", "cp866": "cp866", "cp1251": "windows-1251", "windows-1251": "windows-1251", "cp1252": "windows-1252", "windows-1252": "windows-1252", "utf8": "utf-8", "utf-8": "utf-8"}
SERVICES = {"QO": "quick-open", "RR": "recovery", "CMT": "comment", "ACL": "acl", "STM": "stream"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def version_from_name(name: Column) -> Column:
    """A version from any spelling: case and - _ . space do not count; null if unknown."""
    plain = F.regexp_replace(F.lower(name), "[-_. ]", "")
    short = F.coalesce(_map(SHORT_VERSIONS)[plain], plain)
    return F.when(_map(VERSIONS)[short].isNotNull(), short)


def family(version: Column) -> Column:
    return _map(VERSIONS)[version]


def encoding_from_name(name: Column) -> Column:
    return _map(ENCODINGS)[F.lower(name)]


def service_label(name: Column) -> Column:
    return F.coalesce(_map(SERVICES)[name], name)


def is_unsafe(name: Column) -> Column:
    """NUL, a leading separator, a drive prefix or a component '..'."""
    return F.contains(name, F.lit("\0")) | name.rlike(r"^[/\\]") | name.rlike("^[A-Za-z]:") | F.array_contains(F.split(name, r"[/\\]"), "..")


def is_empty_path(name: Column) -> Column:
    return F.size(F.filter(F.split(name, r"[/\\]"), lambda p: (p != "") & (p != "."))) == 0


def relative_path(name: Column, backslash: bool = False) -> Column:
    """The path without '.' and empty components; null where it is unsafe or empty."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/")) if backslash else name
    parts = F.split(slashed, "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    bad = F.contains(slashed, F.lit("\0")) | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..")
    return F.when(~bad & (F.size(kept) > 0), F.array_join(kept, "/"))


def flat_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def numbered(name: Column, n: Column) -> Column:
    """name(N).ext: the number goes before the extension of the last component."""
    stem, ext = F.regexp_extract(name, r"^(.*?[^/])(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?[^/])(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("("), n.cast("string"), F.lit(")"), ext)


def like_mask(mask: str) -> str:
    """A mask of * and ? as a LIKE pattern with the escape '\\'."""
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in mask.replace("\\", "/"))


def selected(name: Column, masks: list[str]) -> Column:
    """No mask selects all; a mask without a slash is tried on the last component too."""
    if not masks:
        return F.lit(True)
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    found = F.lit(False)
    for mask in masks:
        found = found | slashed.like(like_mask(mask))
        if "/" not in mask.replace("\\", "/"):
            found = found | flat_name(slashed).like(like_mask(mask))
    return found


def old_style(first: Column, index: Column) -> Column:
    """name.r00 ... name.z99 for volume `index`; the first volume is itself; null past .z99."""
    upper = F.regexp_extract(first, r"\.([^./])[^./]*$", 1).rlike("^[A-Z]$")
    step = F.floor((index - 1) / 100).cast("int")
    letter = F.char(F.when(upper, F.lit(82)).otherwise(114) + step)
    ext = F.concat(letter, F.lpad(((index - 1) % 100).cast("string"), 2, "0"))
    return F.when(index == 0, first).when(step <= 8, F.concat(F.regexp_replace(first, r"\.[^./]*$", ""), F.lit("."), ext))


def old_style_index(extension: Column) -> Column:
    low = F.lower(extension)
    return F.when(low.rlike("^[r-z][0-9]{2}$"), 1 + (F.ascii(low) - 114) * 100 + F.substring(low, 2, 2).cast("int"))


def part_width(first: Column) -> Column:
    """Digits of name.partN.rar, .exe or .sfx; null for other names."""
    n = F.length(F.regexp_extract(first, r"(?i)\.part([0-9]+)\.(rar|exe|sfx)$", 1))
    return F.when(n > 0, n)


def part_style(first: Column, index: Column, width: Column) -> Column:
    """name.partN.rar for volume `index`, padded; a self-extracting first volume is followed by .rar ones."""
    sfx = F.regexp_extract(first, r"(?i)\.part[0-9]+(\.exe|\.sfx)$", 1)
    own = F.regexp_extract(first, r"(?i)(\.rar)$", 1)
    suffix = F.when(own != "", own).when((sfx != "") & (sfx == F.upper(sfx)), F.lit(".RAR")).otherwise(F.lit(".rar"))
    stem = F.when(own != "", F.regexp_replace(first, r"(?i)\.rar$", "")).when(sfx != "", F.regexp_replace(first, r"(?i)\.(exe|sfx)$", "")).otherwise(first)
    stem = F.regexp_replace(stem, r"(?i)\.part[0-9]+$", "")
    digits = (index + 1).cast("string")
    return F.concat(stem, F.lit(".part"), F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")), suffix)


def is_sfx_extension(extension: Column) -> Column:
    return F.lower(extension).isin(".exe", ".sfx")


def set_key(name: Column) -> Column:
    """part:stem or old:stem of a volume's file name; null for other files."""
    part = F.regexp_extract(name, r"(?i)^(.*)\.part[0-9]+\.rar$", 1)
    return F.when(name.rlike(r"(?i)\.part[0-9]+\.rar$"), F.concat(F.lit("part:"), part)).when(name.rlike(r"(?i)\.(rar|[r-z][0-9]{2})$"), F.concat(F.lit("old:"), F.regexp_replace(name, r"\.[^.]*$", "")))


def set_position(name: Column) -> Column:
    """0-based place of a volume in its set."""
    part = F.regexp_extract(name, r"(?i)\.part([0-9]+)\.rar$", 1)
    return F.when(part != "", part.cast("int") - 1).when(name.rlike(r"(?i)\.rar$"), F.lit(0)).otherwise(old_style_index(F.substring_index(name, ".", -1)))


def display_text(text: Column) -> Column:
    """Control characters made visible: tab, newline and return as \\t, \\n, \\r, escape as \\u{1b}; all else is kept."""
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x1b", "\\u{1b}"), ("\x07", "\\u{7}")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def comment_text(text: Column) -> Column:
    """A comment for display: trailing NUL, CR and LF go, tabs and newlines stay, escapes are shown as \\x1b."""
    text = F.regexp_replace(text, "[\\x00\\r\\n]+$", "")
    for raw, shown in (("\r", "\\x0d"), ("\x1b", "\\x1b"), ("\x07", "\\x07")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def attribute_source(family_name: Column, host_os: Column) -> Column:
    """Whose attribute word it is: hosts are numbered differently before and after format 5."""
    old = F.when(host_os.isin(0, 1, 2, 4), "dos").when(host_os.isin(3, 5), "unix").otherwise("unknown")
    new = F.when(host_os == 0, "dos").when(host_os == 1, "unix").otherwise("unknown")
    return F.when(family_name == "5+", new).when(family_name == "1.5-4", old).otherwise("dos")


def attribute_string(attr: Column, unix: Column) -> Column:
    """drwxr-xr-x, or the letters DRHSA of set DOS bits with dots between."""
    bit = lambda b: attr.bitwiseAND(b) != 0
    kind = F.when(attr.bitwiseAND(0o170000) == 0o040000, "d").when(attr.bitwiseAND(0o170000) == 0o120000, "l").otherwise("-")
    mode = F.concat(kind, *(F.when(bit(b), c).otherwise("-") for b, c in zip((256, 128, 64, 32, 16, 8, 4, 2, 1), "rwxrwxrwx", strict=True)))
    dos = F.concat(*(F.when(bit(b), c).otherwise(".") for b, c in ((16, "D"), (1, "R"), (2, "H"), (4, "S"), (32, "A"))))
    return F.when(unix, mode).otherwise(dos)


def parse_size(text: Column) -> Column:
    """Bytes of a size with an optional k, m or g; null where it is malformed or overflows 63 bits."""
    t = F.trim(text)
    digits, unit = F.regexp_extract(t, "(?i)^([0-9]+)([kmg]?)$", 1), F.lower(F.regexp_extract(t, "(?i)^([0-9]+)([kmg]?)$", 2))
    factor = F.when(unit == "k", F.lit(1024)).when(unit == "m", F.lit(1 << 20)).when(unit == "g", F.lit(1 << 30)).otherwise(F.lit(1)).cast("long")
    return F.when(digits != "", F.try_multiply(F.expr("1L") * F.try_to_number(F.lpad(digits, 19, "0"), F.lit("9" * 19)).cast("long"), factor))


def clamp_password(text: Column) -> Column:
    return F.substring(text, 1, 127)
