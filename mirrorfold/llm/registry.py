"""The queries of this subpackage and the SQL that checks them, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorfold.llm.bitfiles import op10_token_bit_files
from mirrorfold.llm.hmm import op5_hmm_scores
from mirrorfold.llm.htmltext import op1_html_main_text
from mirrorfold.llm.lzprint import op7_lz_fingerprints
from mirrorfold.llm.mixing import OP6_SQL, op6_mix_sources
from mirrorfold.llm.neardup import OP4_SQL, op4_minhash_near_dedup
from mirrorfold.llm.packing import op3_best_fit_packing
from mirrorfold.llm.pii import op8_pii_surrogates
from mirrorfold.llm.topk import OP9_SQL, op9_exact_top_k
from mirrorfold.llm.toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_main_text, op2_toxicity, op3_best_fit_packing, op4_minhash_near_dedup, op5_hmm_scores, op6_mix_sources, op7_lz_fingerprints, op8_pii_surrogates, op9_exact_top_k, op10_token_bit_files)}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL, "op9_exact_top_k": OP9_SQL}
