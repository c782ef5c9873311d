"""The queries of this subpackage and their SQL, as far as SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.differencing import op12_differencing
from ledgerline.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from ledgerline.llm.html_extraction import op3_html_extraction
from ledgerline.llm.language_id import op5_language_id
from ledgerline.llm.mixing import op7_source_mixing
from ledgerline.llm.packing import op4_best_fit_packing
from ledgerline.llm.periodic_runs import op11_periodic_runs
from ledgerline.llm.quality_rules import op6_quality_rules
from ledgerline.llm.simhash_dedup import op9_simhash_dedup
from ledgerline.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from ledgerline.llm.suffix_dedup import op10_suffix_dedup
from ledgerline.llm.token_alignment import op13_cross_tokenizer
from ledgerline.llm.token_files import op2_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_token_files, op3_html_extraction, op4_best_fit_packing, op5_language_id,
        op6_quality_rules, op7_source_mixing, op8_substring_dedup, op9_simhash_dedup, op10_suffix_dedup,
        op11_periodic_runs, op12_differencing, op13_cross_tokenizer,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op8_substring_dedup": OP8_SQL}
