"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from classlens.llm import oracles
from classlens.llm.exact_dedup import op2_exact_dedup
from classlens.llm.jaccard_join import op9_jaccard_join
from classlens.llm.licenses import op5_license_scan
from classlens.llm.line_dedup import op10_line_dedup
from classlens.llm.mixing import op6_mixing
from classlens.llm.packing import op8_packing
from classlens.llm.periodic_runs import op13_periodic_runs
from classlens.llm.pii import op12_personal_data
from classlens.llm.pii_sql import personal_data
from classlens.llm.quality_rules import op4_quality_rules
from classlens.llm.spelling_variants import op11_spelling_variants
from classlens.llm.substring_dedup import op1_substring_dedup
from classlens.llm.toxicity import op3_toxicity
from classlens.llm.warc import op7_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op4_quality_rules": oracles.QUALITY_RULES,
    "op5_license_scan": oracles.license_scan(),
    "op6_mixing": oracles.MIXING,
    "op7_warc": oracles.WARC,
    "op9_jaccard_join": oracles.JACCARD_JOIN,
    "op11_spelling_variants": oracles.SPELLING_VARIANTS,
    "op12_personal_data": personal_data(),
}
