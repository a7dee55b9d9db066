"""Secret scans by linking the parts of a credential.

A credential has up to three parts: an access identifier, a secret and an endpoint. Strong parts stand for themselves
(the base kinds ``assign``, ``access`` and ``hex``). Weak candidates (``weak_id``: a client, user or key identifier,
``weak_secret``: a long token of mixed character classes, ``endpoint``: a URL, host or address) mean little alone. An interval join
links parts whose stretches come within ``REACH`` code points of one another inside one scope (a block of lines without a blank
line), and a weak candidate is reported only when it is linked to a part of another role. A span of kind
``credential`` covers each identifier with the nearest secret linked to it, and the nearest endpoint of the two.

Scopes never reach beyond a document, so the join is a sweep over each document's sorted parts and needs no shuffle: for every part and
other role the one that ends last among those that begin before it (a running maximum of ends) and the first that begins after it.
No other part of that role is nearer, so no link of a part is lost. Of the two the nearer counts, the earlier on ties. The cost is n log n in the
parts and linear in the text, memory is bounded by one document's parts. A null text is the empty text; it has no span. Equal rows give
equal values; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_row
from .spans import Span, found, joined, sha256, spans_sql

#: Code points between two parts that still belong together.
REACH = 300

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint", "credential"]


def _either(words: str) -> str:
    """ASCII letters in either case, without the case folding of other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = re.compile(rf"""({_either("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of any length of which only those of 24 and more are kept
WEAK_ID = re.compile(rf"""({_either("client_?id|account_?id|access_?key_?id|user_?name|login")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{{3,}})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b")
HOST_END, HOST, HOST_LENGTH = re.compile(r"\.(?:amazonaws\.com|internal|local)\b"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-", 253
BLANK = re.compile(r"\n[^\S\n]*\n")

ROLE = {"access": 0, "weak_id": 0, "assign": 1, "hex": 1, "weak_secret": 1, "endpoint": 2}


def _mixed(m: re.Match) -> bool:
    s = m[0]
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def base_spans(text: str) -> list[Span]:
    spans = found("access", ACCESS, text, lambda m: m.end() - m.start() >= 20) if "AKIA" in text else []
    if "=" in text or ":" in text:
        spans += found("assign", ASSIGN, text, lambda m: len(m[2]) >= 6)
    return spans + found("hex", HEX, text)


def endpoints(text: str) -> list[Span]:
    """URLs, addresses, and host names of some inner domains that lie outside these."""
    spans = found("endpoint", ADDRESS, text)
    last = 0
    taken = iter([*spans, ("endpoint", len(text) + 1, len(text) + 1)])
    _, a, b = next(taken)
    for m in HOST_END.finditer(text):
        while b <= m.start():
            last, (_, a, b) = b, next(taken)
        low = max(last, m.start() - HOST_LENGTH)
        start = low + len(text[low : m.start()].rstrip(HOST))
        start += len(text[start : m.start()]) - len(text[start : m.start()].lstrip(".-"))
        if start < m.start() and m.end() <= a:
            spans.append(("endpoint", start, m.end()))
            last = m.end()
    return spans


def nearest_partners(parts: list[tuple], role: list[tuple], reach: int = REACH) -> list[tuple | None]:
    """For each of the ``parts`` (scope, start, end, kind) the nearest of the sorted ``role`` in its scope within ``reach``; never an equal stretch."""
    last: list[int] = []  # for each of role: which of its scope up to here ends last (the first of equals)
    for i, x in enumerate(role):
        last.append(last[-1] if i and role[i - 1][0] == x[0] and role[last[-1]][2] >= x[2] else i)
    out: list[tuple | None] = []
    for s, a, b, _ in parts:
        i, j = bisect_left(role, (s, a, b)), bisect_left(role, (s, a, b + 1))
        before = role[last[i - 1]] if i and role[i - 1][0] == s else None
        after = role[j] if j < len(role) and role[j][0] == s else None
        gaps = [(max(0, a - before[2]), 0, before)] if before else []
        gaps += [(max(0, after[1] - b), 1, after)] if after else []
        gap, _, x = min(gaps, default=(reach + 1, 0, None), key=lambda g: g[:2])
        out.append(x if gap <= reach else None)
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """What the method adds to the base spans."""
    weak = found("weak_id", WEAK_ID, text) if "=" in text or ":" in text else []
    weak += endpoints(text) if "." in text or "://" in text else []
    weak += found("weak_secret", WEAK_SECRET, text, _mixed)
    if not weak and len(base) < 2:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]

    def free(span: Span) -> bool:  # a weak secret inside a base span, such as the value of an assignment, is that span
        i = bisect_left(starts, span[2]) - 1
        return i < 0 or taken[i][1] <= span[1]

    parts = sorted((a, b, ROLE[k], k) for k, a, b in [*base, *(s for s in weak if s[0] == "endpoint" or free(s))])
    edges = [m.start() for m in BLANK.finditer(text)]
    scope = [bisect_right(edges, a) for a, *_ in parts]
    by_role: list[list[tuple[int, int, int, str]]] = [[], [], []]
    for p, s in zip(parts, scope, strict=True):
        by_role[p[2]].append((s, *p[:2], p[3]))

    partners = [[nearest_partners(row, other) for other in by_role] for row in by_role]
    out: list[Span] = []
    for role, row in enumerate(by_role):
        for i, part in enumerate(row):
            if part[3] in ("weak_id", "weak_secret", "endpoint") and any(partners[role][r][i] for r in range(3) if r != role):
                out.append((part[3], part[1], part[2]))
    secrets = {x: i for i, x in enumerate(by_role[1])}
    for i, part in enumerate(by_role[0]):
        if secret := partners[0][1][i]:
            end = partners[0][2][i] or partners[1][2][secrets[secret]]
            span = [part, secret, *([end] if end else [])]
            out.append(("credential", min(x[1] for x in span), max(x[2] for x in span)))
    return out


def scan(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    n = [sum(k == kind for k, *_ in base) for kind in KINDS[:3]]
    return *n, sha256(joined(base, KINDS)), joined([*base, *linked_spans(text, base)], KINDS)


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the column ``spans``: array of (kind, start, end) of every whole text, base kinds and linked ones."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def fn(t: str | None) -> tuple:
        base = base_spans(t or "")
        return ([{"kind": k, "start": a, "end": b} for k, a, b in [*base, *linked_spans(t or "", base)]],)

    return per_row(docs, text, fn, [("spans", pa.list_(kind), "array<struct<kind:string,start:bigint,end:bigint>>")], list(keep))


def secret_digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    long, string = (pa.int64(), "bigint"), (pa.string(), "string")
    fields = [("n_assign", *long), ("n_access", *long), ("n_hex", *long), ("base_sha256", *string), ("spans", *string)]
    return per_row(docs, text, scan, fields, list(keep))


def op3_secret_scan(spark, sf_dir):
    from .common import table

    return secret_digests(table(spark, sf_dir, "documents"))


#: The base columns by plain patterns.
BASE_SQL = spans_sql([("assign", ASSIGN.pattern, "length(regexp_extract(m, <P>, 2)) >= 6"), ("access", ACCESS.pattern, "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24")])
