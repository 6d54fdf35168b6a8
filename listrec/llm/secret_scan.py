"""Secret scan: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton finds the keywords of all rules in one pass over the
whole text.  The rule's pattern is tried only at a hit, and a token with an
embedded checksum is kept only when the checksum holds.  Long runs of lower-case
hex digits have no keyword; they are found by their own character run.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, span_key

KINDS = ("assign", "access", "hex", "checked", "private_key", "jwt")
N_BASE = 3

# Patterns of the base kinds and of published token formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END [A-Z ]*?PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+")
JWT_PART = re.compile(r"[A-Za-z0-9_-]*+")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
    "-----begin ": "private_key",
    "eyj": "jwt",
}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED, "private_key": PRIVATE_KEY, "jwt": JWT}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def checksum_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the body in base 62, zero-padded."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(2) - m.start(2) >= 12
    if kind == "access":
        return m.end() - m.start() >= 18
    if kind == "checked":
        return checksum_holds(m[2], m[3])
    return True


def find(text: str | None) -> list[tuple[int, int, int]]:
    """Spans ``(start, index of the kind, end)`` in code points, sorted.

    Within a kind, matches are leftmost and do not overlap; a match that fails
    its check is dropped and still uses up its text.  Null gives no span.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(ASCII_LOWER)
    spans, after = [], dict.fromkeys(PATTERNS, 0)
    for last, (n, kind) in automaton().iter(low):
        at = last + 1 - n
        if at < after[kind]:
            continue
        if m := PATTERNS[kind].match(text, at):
            after[kind] = m.end()
            if accepted(kind, m):
                spans.append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt":  # what follows this part fits no token, wherever in the part one starts
            after[kind] = JWT_PART.match(text, at).end()
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Replace each maximal run of overlapping spans by ``mark``."""
    out, done, n = [], 0, len(spans)
    i = 0
    while i < n:
        start, _, end = spans[i]
        while i + 1 < n and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[done:start], mark]
        done, i = end, i + 1
    return "".join([*out, text[done:]])


def scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, count of each base kind, ``base`` and ``spans`` as text.

    Null and empty texts have no spans; rows are independent, so repeated rows
    give repeated results and an empty table an empty result.  Other columns are
    not read.  No match is bounded in length, and the work is linear in it.
    """

    def work(texts: list[str | None]) -> dict[str, list]:
        found = [find(t) for t in texts]
        base = [[s for s in f if s[1] < N_BASE] for f in found]
        counts = {f"n_{KINDS[k]}": [sum(s[1] == k for s in f) for f in base] for k in range(N_BASE)}
        return {**counts, "base": [span_key(f, KINDS) for f in base], "spans": [span_key(f, KINDS) for f in found]}

    return map_texts(documents, work, "n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """A text with every found span replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, s, mark) if t and (s := find(t)) else t for t in texts], dtype=object)

    return clean(text)


def redact_documents(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with their texts redacted; all rows stay, other columns as they are."""
    return documents.withColumn("text", redacted(F.col("text"), mark))
