"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Base kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone``. Added kinds: ``iban`` (mod-97 and the length of its
country) and ``national_id`` (a formatted number that only a context word makes personal). Every span has a score: what
its kind and validator give, raised by a word that speaks for the kind and lowered by one that speaks against it within
``CONTEXT`` code points before it or after it. Base spans stay at any score; added ones need ``MIN_SCORE``.

A null text is the empty text; it has no span. A text costs time linear in its length, whatever runs it holds. Texts are mapped one by one: equal rows
give equal values, an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_row
from .spans import Span, found, joined, sha256, spans_sql

CONTEXT, MIN_SCORE = 60, 0.5
KINDS = ["email", "ip", "card", "phone", "iban", "national_id"]

# Email and IP, taken apart so that long runs cost linear time: spans are those of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and of [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), leftmost without overlaps.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Lengths of the IBAN by country, of the registry of ISO 13616.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
IBAN_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in {*IBAN_LENGTH.values()}}

SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3}
FOR = {
    "email": "mail email contact", "ip": "ip address host server", "card": "card visa mastercard credit payment", "phone": "phone tel call mobile fax",
    "iban": "iban bank account transfer", "national_id": "ssn social security id tax",
}
AGAINST = {"email": "example noreply", "ip": "version release", "card": "order invoice tracking serial isbn", "phone": "version isbn", "iban": "serial part", "national_id": "part order serial"}
WORDS = re.compile(r"[a-z]+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """The sum of digits, every second from the right doubled (less 9 above 9), is a multiple of 10."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, number[-1::-2])) + sum(twice[int(c)] for c in number[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return IBAN_LENGTH.get(code[:2]) == len(code) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_spans(text: str) -> list[Span]:
    """Every country code and check digits with as many characters after them as the country's length asks."""
    out: list[Span] = []
    for m in IBAN.finditer(text):
        n = IBAN_LENGTH.get(m[0][:2])
        rest = IBAN_REST[n].match(text, m.end()) if n and not (out and m.start() < out[-1][2]) else None
        if rest and mod97(text[m.start() : rest.end()]):
            out.append(("iban", m.start(), rest.end()))
    return out


def email_spans(text: str) -> list[Span]:
    """Every ``@`` with the run of local characters before it (from the last match or ``@`` on) and the domain after it."""
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return out


def ip_spans(text: str) -> list[Span]:
    """Four parts in turn of every chain of dotted numbers."""
    out: list[Span] = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in four)):
                out.append(("ip", at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """The cheap tests before each pattern ask for a character that every match holds."""
    spans = email_spans(text) + (ip_spans(text) if "." in text else [])
    spans += found("card", CARD, text, lambda m: 14 <= len(d := digits(m[0])) <= 19 and luhn(d))
    return spans + (found("phone", PHONE, text, lambda m: 10 <= len(digits(m[0])) <= 15) if "+" in text else [])


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: the base ones, and the added ones that reach ``MIN_SCORE``."""
    added = iban_spans(text) + (found("national_id", NATIONAL_ID, text) if "-" in text else [])
    out = []
    for i, (kind, a, b) in enumerate((base := base_spans(text)) + added):
        near = {*WORDS.findall(text[max(0, a - CONTEXT) : a].lower()), *WORDS.findall(text[b : b + CONTEXT].lower())}
        score = SCORE[kind] + (0.3 if near & {*FOR[kind].split()} else 0) - (0.3 if near & {*AGAINST[kind].split()} else 0)
        if i < len(base) or score >= MIN_SCORE:
            out.append((kind, a, b, round(min(1.0, max(0.0, score)), 2)))
    return out


def _digests(text: str | None) -> tuple:
    spans = scored_spans(text or "")
    base = [s[:3] for s in spans if s[0] in KINDS[:4]]
    n = [sum(k == kind for k, *_ in base) for kind in KINDS[:4]]
    scores = ",".join(f"{s[3]:.2f}" for s in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return *n, sha256(joined(base, KINDS)), joined([s[:3] for s in spans], KINDS), scores, len(spans)


def pii_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the column ``spans``: array of (kind, start, end, score) of every whole text."""
    names = ("kind", "start", "end", "score")
    kind = pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)))
    fn = lambda t: ([dict(zip(names, s, strict=True)) for s in scored_spans(t or "")],)
    return per_row(docs, text, fn, [("spans", pa.list_(kind), "array<struct<kind:string,start:bigint,end:bigint,score:double>>")], list(keep))


def pii_digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    long, string = (pa.int64(), "bigint"), (pa.string(), "string")
    fields = [("n_email", *long), ("n_ip", *long), ("n_card", *long), ("n_phone", *long), ("base_sha256", *string), ("spans", *string), ("scores", *string), ("n_spans", *long)]
    return per_row(docs, text, _digests, fields, list(keep))


def op9_pii(spark, sf_dir):
    from .common import table

    return pii_digests(table(spark, sf_dir, "documents"))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 // 10 + CAST(c AS INT) * 2 % 10 END)) % 10 = 0"
#: The base columns by plain patterns.
BASE_SQL = spans_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    ("card", CARD.pattern, f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", PHONE.pattern, f"length({_DIGITS}) BETWEEN 10 AND 15"),
])
