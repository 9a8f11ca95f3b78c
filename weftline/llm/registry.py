"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from weftline.llm import decontaminate, oracles, phrase_mining, secret_scan, url_rules, warc
from weftline.llm.decontaminate import op5_benchmark_containment
from weftline.llm.fm_quality import op9_factorisation_machine
from weftline.llm.jaccard_join import op4_ngram_jaccard_join
from weftline.llm.llr_quality import op2_llr_quality, quality_base_columns
from weftline.llm.packing import op6_hierarchical_packing
from weftline.llm.periodic_runs import op13_periodic_runs
from weftline.llm.phrase_mining import op12_phrase_mining
from weftline.llm.secret_scan import op11_secret_scan, secret_base_columns
from weftline.llm.substring_dedup import op3_substring_dedup
from weftline.llm.suffix_dedup import op10_suffix_array_dedup
from weftline.llm.toxicity import op1_toxicity_ordinal
from weftline.llm.url_rules import op7_url_association_rules, url_fixed_rules
from weftline.llm.warc import op8_warc_salvage

QUERIES: dict[str, Callable] = {
    "op1_toxicity_ordinal": op1_toxicity_ordinal,
    "op2_llr_quality": op2_llr_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_containment": op5_benchmark_containment,
    "op6_hierarchical_packing": op6_hierarchical_packing,
    "op7_url_association_rules": op7_url_association_rules,
    "op8_warc_salvage": op8_warc_salvage,
    "op9_factorisation_machine": op9_factorisation_machine,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_periodic_runs": op13_periodic_runs,
    "quality_base_columns": quality_base_columns,
    "secret_base_columns": secret_base_columns,
    "url_fixed_rules": url_fixed_rules,
}

SQL: dict[str, str] = {
    "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_ngram_jaccard_join": oracles.JACCARD_JOIN,
    "op5_benchmark_containment": decontaminate.SQL,
    "op8_warc_salvage": warc.SQL,
    "op10_suffix_array_dedup": oracles.SUFFIX_DEDUP,
    "op12_phrase_mining": phrase_mining.SQL,
    "quality_base_columns": oracles.QUALITY_BASE,
    "secret_base_columns": secret_scan.SQL,
    "url_fixed_rules": url_rules.FIXED_SQL,
}
