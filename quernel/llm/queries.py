"""What the subpackage registers: queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from . import exact_dedup, licenses, line_dedup, mixing, packing, pii, quality, secrets, simhash, token_counts

QUERIES = {
    "op1_packing": packing.query,
    "op2_mixing": mixing.query,
    "op3_pii": pii.query,
    "op4_quality_rules": quality.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_token_counts": token_counts.query,
    "op7_license_scan": licenses.query,
    "op8_line_dedup": line_dedup.query,
    "op9_secrets": secrets.query,
    "op10_simhash": simhash.query,
}

ORACLE_SQL = {"op5_exact_dedup": exact_dedup.SQL}
