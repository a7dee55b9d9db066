"""Helpers of the operators that report spans of text: order, digest and text form."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

Span = tuple[str, int, int]


def found(kind: str, pattern: re.Pattern, text: str, keep=lambda m: True) -> list[Span]:
    """Leftmost matches that do not overlap; those that ``keep`` refuses are dropped without another try."""
    return [(kind, m.start(), m.end()) for m in pattern.finditer(text) if keep(m)]


def joined(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by the kind's place in ``kinds``, then by end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL of the counts and the digest of base spans. ``kinds``: (kind, pattern, condition on the match ``m``).

    Positions come from the lengths of the matches and of the pieces between them.
    """
    parts = []
    for rank, (kind, pattern, keep) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos, pos + length(m) AS stop FROM (
    SELECT doc_id, m, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS pos
    FROM (SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece
          FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM docs) WHERE len(ms) > 0)) WHERE {keep.replace('<P>', p)}""")
    counts = ", ".join(f"count(CASE WHEN kind = '{kind}' THEN 1 END) AS n_{kind}" for kind, *_ in kinds)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL'.join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos, rank), '')) AS base_sha256
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
