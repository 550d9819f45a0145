"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fingerprint, language_id, line_dedup, mixing, near_dedup, pii, secrets, substring_dedup, toxicity, vector_codes, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {"op8_near_dedup": near_dedup.SQL, "op1_decontaminate": decontaminate.SQL, "op9_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL, "op11_exact_dedup": exact_dedup.SQL, "op13_vector_codes": vector_codes.SQL}
