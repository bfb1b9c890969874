"""The registered queries of the ten operators."""

from __future__ import annotations

from . import decontam, langid, lm_scoring, mixing, near_dup, pii, quality, token_counts, toxicity, warc

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_warc": warc.op2_warc,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality": quality.op4_quality,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_mix_to_targets": mixing.op9_mix_to_targets,
    "op10_language_id": langid.op10_language_id,
}

#: The other operators learn or search in ways that SQL can't express; tests compare them with plain versions.
ORACLE_SQL = {"op2_warc": warc.OP2_SQL, "op8_near_dup": near_dup.OP8_SQL}
