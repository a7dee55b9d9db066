"""The registered queries of this subpackage and the SQL that some of them have.

Beside the numbered ones there are queries of those of their columns that SQL can express, from the same operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_cross_alignment
from .bpe import op2_byte_bpe
from .fingerprints import op8_exact_fingerprint
from .jaccard import OP4_SQL, op4_ngram_jaccard
from .lines import op10_line_templates
from .media import PAYLOADS_SQL, op1_mpeg_audio
from .minhash import OP13_SQL, op13_odd_sketches
from .mixing import OP5_SQL, op5_source_mix
from .negatives import OP11_SQL, op11_hard_negatives
from .pii import BASE_SQL as PII_SQL
from .pii import op9_pii
from .repeats import OP7_SQL, op7_fixed_block_repeats
from .secrets import BASE_SQL as SECRETS_SQL
from .secrets import op3_secret_scan
from .toxicity import op6_toxicity

EDITED_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ordered AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST)) AS n FROM docs)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(n, length(t) // 3)) AS edited_sha256 FROM ordered
"""


def _columns(query: Callable[[SparkSession, str], DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_mpeg_audio, op2_byte_bpe, op3_secret_scan, op4_ngram_jaccard, op5_source_mix, op6_toxicity, op7_fixed_block_repeats, op8_exact_fingerprint, op9_pii, op10_line_templates, op11_hard_negatives,
        op12_cross_alignment, op13_odd_sketches,
    )
    return {f.__name__: f for f in numbered} | {
        "audio_payloads": _columns(op1_mpeg_audio, "doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
        "secret_base_spans": _columns(op3_secret_scan, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
        "edited_texts": _columns(op8_exact_fingerprint, "doc_id", "n_chars", "edited_sha256"),
        "pii_base_spans": _columns(op9_pii, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard": OP4_SQL, "op5_source_mix": OP5_SQL, "op7_fixed_block_repeats": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_odd_sketches": OP13_SQL, "audio_payloads": PAYLOADS_SQL, "secret_base_spans": SECRETS_SQL,
        "edited_texts": EDITED_SQL, "pii_base_spans": PII_SQL,
    }
