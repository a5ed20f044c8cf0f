"""Queries of the training-data operators and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from featurespark.llm.decontaminate import op7_decontaminate
from featurespark.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from featurespark.llm.fingerprints import op8_fingerprints
from featurespark.llm.line_dedup import op1_fuzzy_lines
from featurespark.llm.mixing import op10_mixing
from featurespark.llm.periodic_runs import op11_periodic_runs
from featurespark.llm.quality_crf import op6_quality
from featurespark.llm.sharding import op5_sharding
from featurespark.llm.simhash_dedup import op3_simhash
from featurespark.llm.substring_dedup import OP2_SQL, op2_substring
from featurespark.llm.url_reputation import OP13_SQL, op13_url_filter
from featurespark.llm.warc import OP4_SQL, op4_warc
from featurespark.llm.wavelet import op9_wavelet

QUERIES = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_substring": op2_substring,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_fingerprints": op8_fingerprints,
    "op9_wavelet": op9_wavelet,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}

ORACLE = {"op2_substring": OP2_SQL, "op4_warc": OP4_SQL, "op12_fill_in_middle": OP12_SQL, "op13_url_filter": OP13_SQL}
