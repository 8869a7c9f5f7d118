"""Secret scans by assignment-aware lexing.

Fixed patterns give the base findings. Beyond them, source and configuration syntax is lexed
into name-literal pairs:

    name = "x"   "name": 'x'   name := x   name => x   NAME=x   --name x   table["name"] = "x"
    strings of triple quotes   concatenations with + and ..   lists [ "x", "y" ]   calls set_name("x")
    put("name", "x")   <add key="name" value="x"/>   name: n / value: x   <name>x</name>   YAML blocks name: |

Constants are propagated through names used later in the same text, and a literal is reported
when the name that it reaches is sensitive and the literal looks like a secret rather than a
placeholder, a path or prose. Comments, and strings that hold assignments themselves, are lexed like code:
what is commented out or nested leaks all the same.

A concatenation is read once, part by part, and a name in it stands for what it held then; each
literal is judged once, when the first sensitive name reaches it. So work is linear in the
text, however many parts a secret has and however often constants are built from each other.

Defined cases: null counts as empty, an empty text has no findings; each row is scanned by
itself, so repeated rows give repeated results; matches that fail a length test are dropped
without retrying inside them; offsets are code points, ends exclusive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_HEX = bytes(120 if 48 <= b < 58 or 97 <= b < 103 else 32 for b in range(256))
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of sensitive names and their weights; a name is reported from a score of 2 on.
SENSITIVE = {"password": 3, "passwords": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 2, "tokens": 2, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "private": 1, "api": 1, "access": 1, "key": 1, "client": 0, "signing": 1, "encryption": 1, "session": 1, "jwt": 2, "salt": 1, "cert": 1}
HARMLESS = {"count": 3, "length": 3, "limit": 3, "max": 2, "min": 2, "file": 2, "path": 2, "url": 3, "uri": 3, "name": 2, "type": 3, "id": 1, "ttl": 3, "expiry": 3, "field": 2, "label": 3, "hint": 3, "public": 3, "policy": 3, "index": 2, "column": 2, "prompt": 3}
_PLACEHOLDER = re.compile(r"(?i)(change.?me|example|placeholder|your|dummy|sample|redacted|none|null|true|false|undefined|x{4,}|\*{3,}|\.{3,}|todo|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})")
#: What a value may follow: a name (in quotes or a subscript, too) and a sign, an opening call, a comma after a quoted name, or the space after a flag.
_TARGET = re.compile(r"""(?<![\w.\-])(--)?(["']?)([A-Za-z_][\w.\-]*+)(["']?)\]?(?:[ \t]*+(?P<sign>:=|=>|=(?!=)|:(?![:/]))|[ \t]*+(?P<call>\()|(?P<comma>,)(?=[ \t]*+["'])|(?P<flag>[ \t]))[ \t]*+""")
_VALUE = re.compile(r'''(?:[bBrRuUfF]{0,2}"""((?:[^"\\]|\\(?s:.)|"(?!""))*+)"""|[bBrRuUfF]{0,2}"((?:[^"\\\n]|\\.)*+)"|[bBrRuUfF]{0,2}'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|(\$\{?)?([A-Za-z0-9+/_.=\-]++)\}?)''', re.A)
_YAML = re.compile(r"[|>][+-]?\d?[ \t]*\n((?:[ \t]++[^\n]*+(?:\n|\Z)|[ \t]*+\n)++)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-:]*+)(?:\s[^<>]*+)?>([^<>\n]++)</")
_QUOTES = ("'", '"', "`")
_COMMA = re.compile(r"\s*+,\s*+")
_BESIDE = re.compile(r"""["'\s,]*""")
#: Names whose literal is itself the name of the value beside it.
_KEYS, _VALUES = frozenset(("key", "name", "id", "property", "field", "variable")), frozenset(("value", "val", "content"))
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base findings."""
    found: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX):
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


@lru_cache(1 << 16)
def name_score(name: str) -> int:
    """How sensitive a target name is: the weights of its words, less those of harmless ones."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = set(parts) | {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(SENSITIVE.get(p, 0) for p in joined) - sum(HARMLESS.get(p, 0) for p in parts)


_HINT = re.compile("|".join(sorted((w for w, n in SENSITIVE.items() if n), key=len, reverse=True)))


def literal_score(value: str, quoted: bool) -> float:
    """Entropy for each character, none for placeholders, prose and short values."""
    if "PRIVATE KEY-----" in value:
        return 6.0
    if len(value) < 6 or _PLACEHOLDER.search(value) or value.count(" ") > 2:
        return 0.0
    if not quoted and not (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
        return 0.0
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


class _Parts:
    """Values and concatenations of one text, each read once: [literal, part that a name stands for, next part, whether any literal is in reach]."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.all: list[list] = []
        self.begun: dict[int, tuple[int, int]] = {}  # the part that begins at each place, and where its value ends
        self.known: dict[str, int] = {}
        self.judged: set[int] = set()
        self.found: set[tuple[int, str, int]] = set()

    def read(self, at: int) -> tuple[int | None, int]:
        """The first part of the value at a place, None if no literal is in its reach; and the end of the value."""
        own, follows, end = [], None, at
        while v := _VALUE.match(self.text, at):
            if at in self.begun:
                follows, end = self.begun[at]
                break
            k = next(i for i in (1, 2, 3, 4, 6) if v[i] is not None)
            name = v[6] if k == 6 else None
            stands = self.known.get(name) if name is not None else None
            literal = (v.start(k), v.end(k), k != 6) if stands is None and (name is None or not v[5]) else None
            end = v.end()
            own.append(len(self.all))
            self.begun[at] = len(self.all), end
            self.all.append([literal, stands, None, literal is not None or stands is not None])
            plus = _PLUS.match(self.text, end)
            if not plus:
                break
            at = plus.end()
        for i in reversed(own):
            self.all[i][2] = follows
            self.all[i][3] |= follows is not None and self.all[follows][3]
            follows = i
        return (follows if follows is not None and self.all[follows][3] else None), end

    def literal(self, start: int, end: int, quoted: bool) -> int:
        """A part that is one literal."""
        self.all.append([(start, end, quoted), None, None, True])
        return len(self.all) - 1

    def judge(self, first: int, strict: bool = False) -> None:
        """Reports the secrets in reach of a part that a sensitive name is given. strict: a quoted literal needs digits and letters, too."""
        todo = [first]
        while todo:
            if (i := todo.pop()) is None or i in self.judged:
                continue
            self.judged.add(i)
            literal, stands, after, _ = self.all[i]
            todo += [stands, after]
            if literal is not None and literal_score(self.text[literal[0] : literal[1]], literal[2] and not strict) >= 2.5:
                self.found.add((literal[0], "literal", literal[1]))


def _yaml_block(text: str, at: int, name_at: int) -> tuple[int, int] | None:
    """The lines of a block scalar that are indented deeper than its name, without the outer white space."""
    if not (m := _YAML.match(text, at)):
        return None
    line = text.rfind("\n", 0, name_at) + 1
    indent = len(text[line:name_at]) - len(text[line:name_at].lstrip(" \t"))
    end = m.start(1)
    for row in m[1].splitlines(keepends=True):
        if row.strip() and len(row) - len(row.lstrip(" \t")) <= indent:
            break
        end += len(row)
    body = text[m.start(1) : end]
    start = m.start(1) + len(body) - len(body.lstrip())
    return (start, m.start(1) + len(body.rstrip())) if body.strip() else None


def literal_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of literals that reach a sensitive name, by way of constants too."""
    if not _HINT.search(text.lower().replace("_", "").replace("-", "")):
        return []
    parts = _Parts(text)
    beside: tuple[str, int] | None = None  # the literal of the last key, and where it ends
    for m in _TARGET.finditer(text):
        name, at = m[3], m.end()
        if m["sign"]:
            if beside is not None and name.lower() in _VALUES and _BESIDE.fullmatch(text, beside[1], m.start()):
                name = beside[0]
            beside = None
            if block := _yaml_block(text, at, m.start()):
                first, end = parts.literal(*block, True), block[1]
            elif text.startswith("[", at):
                at += 1
                while at < len(text) and text[at] in " \t\r\n":
                    at += 1
                while True:
                    first, end = parts.read(at)
                    if first is not None and name_score(name) >= 2:
                        parts.judge(first)
                    if end == at or not (comma := _COMMA.match(text, end)):
                        break
                    at = comma.end()
                continue
            else:
                first, end = parts.read(at)
            if m[3].lower() in _KEYS and end > at:
                beside = text[at:end].strip("\"'"), end
            if first is None:
                continue
            parts.known[m[3]] = first
            if name_score(name) >= 2:
                parts.judge(first)
        elif name_score(name) >= 2:
            if m["flag"] and not m[1] or m["comma"] and not m[4]:
                continue
            while True:
                if m["call"] and text[at : at + 1] not in _QUOTES and _name(text, at) not in parts.known:
                    break  # words in brackets are no literals
                first, end = parts.read(at)
                if first is not None:
                    parts.judge(first, strict=bool(m["comma"]))
                if not m["call"] or end == at or not (comma := _COMMA.match(text, end)):
                    break
                at = comma.end()
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            if name_score(m[1]) >= 2 and (value := m[2].strip()):
                start = m.start(2) + m[2].index(value)
                parts.judge(parts.literal(start, start + len(value), True))
    return list(parts.found)


_WORD = re.compile(r"[A-Za-z_][\w.\-]*+")


def _name(text: str, at: int) -> str | None:
    m = _WORD.match(text, at)
    return m[0] if m else None


def spans_of(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base findings, all findings), each by start and then kind as listed in KINDS."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted([*base, *literal_spans(text)], key=order)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = spans_of(text.as_py())
                n = Counter(k for _, k, _ in every)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n["literal"]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
