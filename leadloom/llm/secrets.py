"""Secret scans by assignment-aware lexing.

Source and configuration syntax is parsed into (target name, literal) pairs: ``name = "x"``,
``name: x``, ``"name": "x"``, ``NAME=x``, ``name := 'x'``, ``name => "x"``, ``--name x``,
``<name>x</name>``. A literal is a quoted or triple-quoted string, several of them joined by
``+`` or by standing side by side (over lines and comments, in parentheses or after a
backslash too), or a bare word up to white space or punctuation. A right-hand side that
is a plain identifier is replaced by the constant assigned to that name, the last one
before it or else the first one after it, followed through chains; the span reported is
that of the constant. A literal's score is the weight of its target's most sensitive name
part, scaled by the literal's length and character entropy, with placeholders scored 0.

Three fixed patterns (assign, access, hex) are always reported; the lexer adds spans
of kind ``lexed`` where they do not overlap one of those. Offsets are code points, end
exclusive. Whole texts are scanned, in time proportional to their length whatever they
hold: a name is tried only where none of its characters stands before it, and repeats do
not give back what they took.

Null text is empty and has no spans; an empty table gives no rows. Rows are scanned one
by one, so repeated rows get equal results and null ids keep theirs. Columns other than
doc_id and text are ignored by scan_secrets, whatever their names; redact_secrets keeps
them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so shorter runs need not be matched and dropped
KINDS = ("assign", "access", "hex", "lexed")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Weight of a target's name part.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.7, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "key": 0.6, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.5, "dsn": 0.6,
}
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "placeholder", "undefined", "redacted", "xxxxxxxx", "password", "secret", "string", "optional"}
LEAST_SCORE = 0.45
LEAST_CHARS = 8

_TARGET = re.compile(
    r"(?<![A-Za-z0-9_.$-])(?:"
    r"-*+(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)[\"']?[\x20\t]*+(?:::=|:=|=>|=(?![=~])|:(?![:/]))"
    r"|--(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)[\x20\t]++(?![-:=])"
    r"|<(?P<tag>[A-Za-z_][A-Za-z0-9_.-]*+)>(?=[^<>\s]++</))"
)
_STRING = re.compile(r"[A-Za-z]{0,2}(?:\"\"\"(?P<t1>(?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'{3}(?P<t2>(?:[^'\\]|\\.|'(?!'{2}))*+)'{3}|\"(?P<s1>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s2>(?:[^'\\\n]|\\.)*+)')", re.S)
_BARE = re.compile(r"[^\s\"',;{}()\[\]<>]++")
_OPEN = re.compile(r"[\x20\t]*+(?:\\\r?\n\s*+)?(?:(\()\s*+)?")
_GAP = re.compile(r"(?:[\x20\t]++|\\\r?\n)*+")
_WIDE_GAP = re.compile(r"(?:\s++|\\\r?\n|(?:\#|//)[^\n]*+)*+")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, ordered."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    parts = [x.lower() for x in _PARTS.findall(name.rsplit(".", 1)[-1])]
    joined = ["".join(x) for x in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(x, 0.0) for x in parts + joined), default=0.0)


def literal_score(name: str, literal: str) -> float:
    """0 to 1: how much a literal assigned to this name looks like a secret."""
    weight = name_weight(name)
    if not weight or len(literal) < LEAST_CHARS or literal.lower() in PLACEHOLDERS or re.search(r"\s|\$\{|%\(|\{\{|^<.*>$", literal):
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return weight * min(1.0, n / 16 + 0.5) * min(1.0, entropy / 3.0)


def _value(text: str, at: int) -> tuple[str, int, int, bool] | None:
    """(literal, start, end, quoted) of what stands at a place, joined strings as one."""
    m = _OPEN.match(text, at)
    wide, at = m[1] is not None, m.end()
    parts, start, end = [], 0, 0
    while m := _STRING.match(text, at):
        g = m.lastgroup
        start = start if parts else m.start(g)
        parts.append(m[g])
        end, at = m.end(g), m.end()
        gap = _WIDE_GAP.match(text, at).end() if wide else _GAP.match(text, at).end()
        plus = gap if wide else _WIDE_GAP.match(text, at).end()  # a + may lead the next line
        if text.startswith("+", plus):
            at = _WIDE_GAP.match(text, plus + 1).end()
        elif gap > at:
            at = gap
        else:
            break
    if parts:
        return "".join(parts), start, end, True
    m = _BARE.match(text, at)
    return (m[0], m.start(), m.end(), False) if m else None


def lex(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of each assignment, in order of text."""
    at = 0
    while m := _TARGET.search(text, at):
        at = m.end()
        if got := _value(text, at):
            yield m["name"] or m["flag"] or m["tag"], *got
            at = got[1] if got[3] else got[2]  # what is quoted may hold assignments itself


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach LEAST_SCORE, constants propagated."""
    if not any(x in text for x in ("=", ":", "--", "</")):
        return []
    pairs = list(lex(text))
    first: dict[str, int] = {}
    for i, (name, *_) in enumerate(pairs):
        first.setdefault(name, i)
    last: dict[str, int] = {}
    refers = []  # to the assignment whose value an identifier stands for
    for i, (name, literal, _, _, quoted) in enumerate(pairs):
        refers.append(i if quoted else last.get(literal, first.get(literal, i)))
        last[name] = i
    found, value = set(), [-1] * len(pairs)  # the assignment with the literal, -2 for a circle
    for i, (name, *_) in enumerate(pairs):
        way, j = [], i
        while value[j] == -1 and refers[j] != j:
            value[j] = -2
            way.append(j)
            j = refers[j]
        root = j if value[j] == -1 else value[j]
        for k in [*way, j]:
            value[k] = root
        if root < 0:
            continue
        _, literal, start, end, quoted = pairs[root]
        if not quoted and _IDENT.match(literal) and not any(c.isdigit() for c in literal):
            continue  # an identifier or a plain word without a known constant
        if literal_score(name, literal) >= LEAST_SCORE:
            found.add((start, end))
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind index, end), by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = lexed_spans(text)
    if more:
        starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max, initial=0))
        more = [(a, 3, b) for a, b in more if ends[bisect_left(starts, b)] <= a]  # no base span that starts before b ends after a
    return base, sorted(base + more)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mask: str = "[secret:{kind}]") -> str | None:
    """The text with each span replaced; overlapping spans are replaced as one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for a, k, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mask.format(kind=KINDS[k])]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        out = []
        for t in docs["text"]:
            base, spans = scan(t)
            n = Counter(k for _, k, _ in spans)
            out.append((n[0], n[1], n[2], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), n[3]))
        got = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])
        got.insert(0, "doc_id", docs["doc_id"].to_numpy(dtype=object))
        yield got.astype({"n_assign": "int64", "n_access": "int64", "n_hex": "int64", "n_lexed": "int64"})


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), with counts, digest of the base spans, and all spans."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(_scan_batches, SCAN_SCHEMA)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the spans in its text replaced, and n_chars (where there is one) made to agree."""
    from pyspark.sql import functions as F

    clean = F.pandas_udf(lambda s: s.map(redact, na_action="ignore"), "string")
    out = docs.withColumn("text", clean(docs["text"]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
