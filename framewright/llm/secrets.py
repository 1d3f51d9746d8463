"""Secret scans: patterns and sliding-window entropy over candidate strings.

Patterns find assignments, access keys and long hexadecimal strings. Beyond
them, runs of key-like characters are cut into stretches of one character
class; a window slides over each stretch with counts that change by one
character in and one out, and windows whose Shannon entropy reaches the
class's threshold are joined into spans. UUIDs, web paths, word-like segments of
paths, counting sequences and placeholders are cut out by position, and so are
the patterns' spans, since those stay.

Defined cases: null text is empty; a text without a finding has '' as spans;
offsets count code points, ends are exclusive; spans that start together come
by kind, then by end; equal texts have equal spans, however often they occur;
texts of any length are scanned whole, in time that grows with the length;
other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from math import log2

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Maximal runs that are long enough: what is left of all runs `[0-9a-f]+`.
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Name, characters, window and least entropy (bits) of each class; a random
#: window has about 3.2, 3.6, 3.6 (base32 3.5) and 3.8 bits.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 16, 2.8),
    ("lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 16, 3.0),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16, 3.0),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 16, 3.3),
)
#: Least shares of changes of kind, and of capitals in a row or lone small
#: letters, in mixed case with few digits; random letters have 0.5 and 0.3.
TURNS, ROUGH = 0.28, 0.12
LONE = re.compile(r"(?<!l)l(?!l)")
#: What is cut out of a run: UUIDs, counting sequences, word-like segments of a
#: path, placeholders with the letters and digits around them, and of the text
#: web addresses up to a query.
ALLOW = re.compile(r"(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])|0123456789|12345678|abcdefgh|x{6,}", re.I)
SEGMENT = re.compile(r"(?<![^/])(?:[A-Z]?[a-z]{2,}[0-9]{0,2}|[0-9]{4})(?:[_-](?:[A-Z]?[a-z]{2,}[0-9]{0,2}|[0-9]{1,4}))*(?![^/])")
PLACEHOLDER, AROUND = re.compile(r"example|sample|placeholder", re.I), 40
WEB = re.compile(r"(?:https?://|\bwww\.)[^\s?#\"'<>]*", re.I)
_TERM = [0.0]


def _term(n: int) -> float:
    while len(_TERM) <= n:
        _TERM.append(len(_TERM) * log2(len(_TERM)))
    return _TERM[n]


def windows(text: str, width: int) -> Iterator[float]:
    """Shannon entropy of each window, from counts kept up by differences."""
    counts: dict[str, int] = {}
    total = 0.0
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += _term(n + 1) - _term(n)
        counts[c] = n + 1
        if k >= width:
            o = text[k - width]
            n = counts[o]
            total += _term(n - 1) - _term(n)
            counts[o] = n - 1
        if k >= width - 1:
            yield log2(width) - total / width


def _kinds(s: str) -> str:
    """Letters and digits of a string as d, l or u."""
    return "".join("d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" for c in s if c.isalnum())


def _mixed(s: str, kind: str) -> bool:
    """Letters and digits as keys have them; words and numbers don't.

    Few digits in mixed case pass only where case changes often and not as at
    the start of words: capitals in a row, or one small letter between capitals.
    """
    kinds = _kinds(s)
    digits = kinds.count("d")
    if kind == "hex":
        return 2 <= digits <= len(s) - 2
    if kind == "base64":
        turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
        rough = kinds.count("uu") + len(LONE.findall(kinds))
        return "l" in kinds and "u" in kinds and (digits >= 2 or turns >= TURNS * len(kinds) and rough >= ROUGH * len(kinds))
    changes = sum(a != b and a + b != "ul" for a, b in zip(kinds, kinds[1:]))
    return digits >= 1 and len(kinds) > digits and changes >= (3 if kind == "lower" else 2)


def allowed(run: str) -> list[tuple[int, int]]:
    """Places in a run that hold no secret."""
    out = [m.span() for m in ALLOW.finditer(run)]
    if len(words := [m.span() for m in SEGMENT.finditer(run)] if "/" in run else []) > 1:  # one may be chance
        out += words
    for m in PLACEHOLDER.finditer(run):
        a, b = m.span()
        while a > max(0, m.start() - AROUND) and run[a - 1].isalnum():
            a -= 1
        while b < min(len(run), m.end() + AROUND) and run[b].isalnum():
            b += 1
        out.append((a, b))
    return out


def outside(a: int, b: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the cuts leave of a range."""
    for s, e in sorted(cuts):
        if s > a:
            yield a, min(s, b)
        a = max(a, e)
        if a >= b:
            return
    if a < b:
        yield a, b


def found_in(run: str) -> list[list[int]]:
    """Joined windows of high entropy in a run, of all classes together.

    The mix is asked of a whole stretch; a window needs two kinds of character.
    """
    spans = []
    for kind, chars, width, least in CLASSES:
        at = 0
        while at < len(run):
            end = at
            while end < len(run) and run[end] in chars:
                end += 1
            part = run[at:end]
            if len(part) >= width and _mixed(part, kind):
                spans += [[at + k, at + k + width] for k, bits in enumerate(windows(part, width)) if bits >= least and len(set(_kinds(part[k : k + width]))) > 1]
            at = end + 1
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return found


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, known: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Joined windows of high entropy in candidates, outside of what is allowed or known.

    Candidates and known places are swept together, both in order.
    """
    out = []
    web = [m.span() for m in WEB.finditer(text)] if "://" in text or "www." in text.lower() else []
    taken, at = joined((*web, *known)), 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        run = m.group()
        if run.islower() and not any("0" <= c <= "9" for c in run):
            continue
        cuts, k = [(m.start() + a, m.start() + b) for a, b in allowed(run)], at
        while k < len(taken) and taken[k][0] < m.end():
            cuts.append(taken[k])
            k += 1
        for s, e in outside(m.start(), m.end(), cuts):
            out += [(s + a, s + b) for a, b in found_in(text[s:e])]
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns, each kind leftmost first."""
    low = text.lower()
    out = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    more = [(a, "entropy", b) for a, b in entropy_spans(text, [(s, e) for s, _, e in base])]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def scanned(text: Column) -> Column:
    """A text column as arrays of spans (kind, start, end)."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: [{"kind": k, "start": s, "end": e} for s, k, e in scan(t)])

    return find(text)


def redact(text: str | None) -> str | None:
    """A text with each secret (of an assignment its value) replaced."""
    if not text:
        return text
    out, at = [], 0
    for s, kind, e in scan(text):
        if kind == "assign":
            s = ASSIGN.match(text, s).start(2)
        if e > at:
            out += [text[at : max(at, s)], "" if s < at else f"<{kind}-redacted>"]
            at = e
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """A text column without its secrets; null stays null."""

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(redact)

    return clean(text)
