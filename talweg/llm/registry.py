"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from talweg.llm.op10_media_jpeg import op10_media_jpeg
from talweg.llm import op11_filter_audit as audit
from talweg.llm.op12_periodic_runs import op12_periodic_runs
from talweg.llm.op13_quality_perplexity import op13_quality_perplexity
from talweg.llm.op1_license_scan import op1_license_scan
from talweg.llm.op2_minhash_dedup import op2_minhash_dedup
from talweg.llm.op3_toxicity import op3_toxicity
from talweg.llm.op4_packing import op4_packing
from talweg.llm.op5_pii import op5_pii
from talweg.llm.op6_embedding_dedup import op6_embedding_dedup
from talweg.llm.op7_token_codes import op7_token_codes
from talweg.llm.op8_chat_threads import op8_chat_threads
from talweg.llm.op9_mixing import op9_mixing


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_minhash_dedup, op3_toxicity, op4_packing, op5_pii, op6_embedding_dedup, op7_token_codes, op8_chat_threads, op9_mixing, op10_media_jpeg, audit.op11_filter_audit, op12_periodic_runs, op13_quality_perplexity)}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": audit.ORACLE_SQL}
