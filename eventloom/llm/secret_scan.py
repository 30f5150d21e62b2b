"""Secret scans.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over a text; the
regular expressions are tried only where a keyword stands, anchored there. Kinds of
tokens that embed a checksum are reported only if it is right. Runs of hex digits have
no keyword; one linear pattern finds them.

Offsets are code points, ends exclusive. Within a kind, matches are the leftmost ones
that do not overlap.

Defined results: a null text counts as empty and has no spans; very long texts are
scanned whole; rows that repeat get a result each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import ship_package

#: Kinds in the order in which spans at the same place are listed.
KINDS = ("assign", "access", "hex", "forge_token", "package_token")

#: The keywords of each kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package_token": ("npm_",),
}

#: What must follow from a keyword on.
PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "forge_token": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "package_token": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_A_TO_Z = {c: c + 32 for c in range(65, 91)}

SCHEMA = "spans array<struct<kind: string, start: int, end: int>>"


def checksum_holds(token: str) -> bool:
    """The last six characters are the base-62 CRC-32 of the 30 before them."""
    value, digits = zlib.crc32(token[4:34].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == token[34:40]


def _passes(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= MIN_VALUE
    return len(match[0]) >= MIN_ACCESS if kind == "access" else checksum_holds(match[0])


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            words.add_word(word, (kind, len(word)))
    words.make_automaton()
    return words


def find_secrets(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter that becomes two
        lowered = text.translate(_A_TO_Z)
    free = dict.fromkeys(PATTERNS, 0)
    spans = []
    for last, (kind, length) in words.iter(lowered):
        start = last - length + 1
        if start >= free[kind] and (match := PATTERNS[kind].match(text, start)):
            free[kind] = match.end()
            if _passes(kind, match):
                spans.append((kind, start, match.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    words = automaton()
    for texts in batches:
        yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t or "", words)] for t in texts])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its spans (kind, start, end)."""
    ship_package(docs.sparkSession)
    scan = F.pandas_udf(_scan, SCHEMA.removeprefix("spans "))
    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col).cast("string")).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and joined spans of `scan_secrets`' result."""

    def listed(kinds):
        some = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = KINDS[:3]
    return spans.select(
        "doc_id", *[count(k) for k in base], F.sha2(listed(base), 256).alias("base_sha256"), listed(KINDS).alias("spans")
    )
