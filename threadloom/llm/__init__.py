"""Operators for large training-data pipelines; nothing outside this folder imports them."""

from threadloom.llm import chat_format as _chat_format
from threadloom.llm import collocations as _collocations
from threadloom.llm import license_scan as _license_scan
from threadloom.llm import mixing as _mixing
from threadloom.llm import packing as _packing
from threadloom.llm import quality_classifier as _quality_classifier
from threadloom.llm import quality_rules as _quality_rules
from threadloom.llm import secret_scan as _secret_scan
from threadloom.llm import simhash_dedup as _simhash_dedup
from threadloom.llm import token_counts as _token_counts
from threadloom.llm import topk_search as _topk_search
from threadloom.llm import warc as _warc
from threadloom.llm import word_runs as _word_runs

#: name -> (spark, sf_dir) -> DataFrame
QUERIES = {
    "op1_secret_scan": _secret_scan.op1_secret_scan,
    "op2_token_counts": _token_counts.op2_token_counts,
    "op3_quality_classifier": _quality_classifier.op3_quality_classifier,
    "op4_license_scan": _license_scan.op4_license_scan,
    "op5_simhash_dedup": _simhash_dedup.op5_simhash_dedup,
    "op6_chat_format": _chat_format.op6_chat_format,
    "op7_quality_rules": _quality_rules.op7_quality_rules,
    "quality_ablations": _quality_rules.quality_ablations,
    "op8_best_fit_packing": _packing.op8_best_fit_packing,
    "op9_topk_search": _topk_search.op9_topk_search,
    "op10_mixing": _mixing.op10_mixing,
    "op11_warc": _warc.op11_warc,
    "op12_word_runs": _word_runs.op12_word_runs,
    "op13_collocations": _collocations.op13_collocations,
}

#: name -> DuckDB SQL with the same rows
ORACLES = {
    "op6_chat_format": _chat_format.ORACLE,
    "op7_quality_rules": _quality_rules.ORACLE,
    "quality_ablations": _quality_rules.ABLATIONS,
    "op9_topk_search": _topk_search.ORACLE,
    "op11_warc": _warc.ORACLE,
    "op13_collocations": _collocations.ORACLE,
}
