"""Secret scans with multipart credential linking (operator 9).

Every whole text is scanned for strong matches (assigned secrets, access keys,
long hexadecimal runs) and for weak parts of credentials: short or unusual
access identifiers, secrets that could be any random string, endpoints. A weak
part is reported only if complementary parts stand in its scope: an identifier
next to a secret, a secret next to an identifier, an endpoint next to both.
Scopes are the text between blank lines; inside one, parts link however far
apart they are, unless the caller bounds that by ``reach`` code points. The link
is an interval join of sorted positions by binary search, so no pairs are made,
however many parts a scope holds.

Defined results: null and empty texts have no spans; offsets are code points,
the end exclusive; a weak part that overlaps a strong match is that match;
overlapping weak parts of a kind are the leftmost. A very long text is scanned
whole, in work that grows with its length; a null id is an id like any other;
columns named like a result are replaced, others stay or go as ``keep`` says.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
STRONG = ["assign", "access", "hex"]

#: Weak parts by role. The last group of a pattern is the span if it has groups.
#: A run of a secret's letters is tried at its first letter only and without going back, so its length needs no bound;
#: an equals sign may stand before it, as in KEY=value.
_WEAK_ID = re.compile(r"""\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}\b|(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.A)
_WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])""", re.A)
_ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::\d+)?(?:/[^\s\"'<>]*)?|(?<![a-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|azure\.com|googleapis\.com|internal)(?![a-z0-9-])(?::\d+)?", re.A)
LINKED = ["access_part", "secret_part", "endpoint_part"]
KINDS = STRONG + LINKED
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _weak(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span(m.lastindex or 0) for m in pattern.finditer(text)]


class _Near:
    """Parts by start and by end; no part crosses the border of a scope, as none holds a line end."""

    def __init__(self, parts: list[tuple[int, int]]):
        self.starts = sorted(a for a, _ in parts)
        self.ends = sorted(b for _, b in parts)

    def has(self, start: int, end: int, reach: int | None, low: int, high: int) -> bool:
        """Is there a part in [low, high), before start or after end, at most reach away if that is given?"""
        if reach is not None:
            low, high = max(low, start - reach - 1), min(high, end + reach + 1)
        i = bisect.bisect_left(self.starts, end)
        if i < len(self.starts) and self.starts[i] < high:
            return True
        i = bisect.bisect_right(self.ends, start) - 1
        return i >= 0 and self.ends[i] > low


def _free(parts: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts that overlap nothing of taken."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, b in parts:
        i = bisect.bisect_right(ends, a)
        if i == len(starts) or starts[i] >= b:
            out.append((a, b))
    return out


def _scopes(text: str) -> list[int]:
    return [0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1]


def scan(text: str | None, reach: int | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans."""
    if not text:
        return [], []
    base = strong_spans(text)
    weak_secrets = _weak(_WEAK_SECRET, text)
    weak_ids = _weak(_WEAK_ID, text)
    if not (weak_secrets or weak_ids) or not (weak_secrets or base) or not (weak_ids or base):
        return base, base
    taken = [(a, b) for a, b, _ in base]
    weak_secrets, weak_ids = _free(weak_secrets, taken), _free(weak_ids, taken)
    ids = _Near([(a, b) for a, b, k in base if k == "access"] + weak_ids)
    secrets = _Near([(a, b) for a, b, k in base if k != "access"] + weak_secrets)
    edges = _scopes(text)
    found = list(base)
    for kind, parts, others in (
        ("access_part", weak_ids, [secrets]),
        ("secret_part", weak_secrets, [ids]),
        ("endpoint_part", _free(_weak(_ENDPOINT, text), taken) if ids.starts and secrets.starts else [], [ids, secrets]),
    ):
        for a, b in parts:
            at = bisect.bisect_right(edges, a)
            if all(o.has(a, b, reach, edges[at - 1], edges[at]) for o in others):
                found.append((a, b, kind))
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first in square brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind}]"]
        at = end
        i += 1
    return "".join(out) + text[at:]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan_secrets(df: DataFrame, reach: int | None = None, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Adds base_spans and all_spans (start, end, kind), and the redacted text if asked for; a narrow step."""

    def make():
        def compute(values: list) -> list[list]:
            got = [scan(v, reach) for v in values]
            dicts = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            out = [[dicts(x) for x, _ in got], [dicts(y) for _, y in got]]
            if redacted:
                out.append([v if v is None else redact(v, y) for v, (_, y) in zip(values, got, strict=True)])
            return out

        return compute

    fields = [("base_spans", _SPANS), ("all_spans", _SPANS), ("redacted", T.StringType())]
    return append_columns(df, make, fields[: 2 + redacted], keep=keep)
