"""The registered queries of this subpackage, and their SQL counterparts where SQL has one."""

from __future__ import annotations

import corpus_pipeline
from fileledger.llm.alignment import op11_alignment
from fileledger.llm.decontamination import SQL as CONTAMINATION_SQL
from fileledger.llm.decontamination import op4_contamination
from fileledger.llm.language import op3_language
from fileledger.llm.license_scan import SQL as LICENSE_SCAN_SQL
from fileledger.llm.license_scan import op12_license_scan
from fileledger.llm.pieces import op7_pieces
from fileledger.llm.repeated_bytes import SQL as REPEATED_BYTES_SQL
from fileledger.llm.repeated_bytes import op5_repeated_bytes
from fileledger.llm.repeated_words import SQL as REPEATED_WORDS_SQL
from fileledger.llm.repeated_words import op2_repeated_words
from fileledger.llm.simhash import op8_simhash
from fileledger.llm.token_files import op10_token_files
from fileledger.llm.tool_calls import SQL as TOOL_CALLS_SQL
from fileledger.llm.tool_calls import op6_tool_calls
from fileledger.llm.toxicity import op1_toxicity
from fileledger.llm.weighted_sampling import op9_weighted_fingerprints
from fileledger.llm.whitening import op13_whitening

LLM_QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_repeated_words": op2_repeated_words,
    "op3_language": op3_language,
    "op4_contamination": op4_contamination,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_tool_calls": op6_tool_calls,
    "op7_pieces": op7_pieces,
    "op8_simhash": op8_simhash,
    "op9_weighted_fingerprints": op9_weighted_fingerprints,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_whitening": op13_whitening,
}

LLM_ORACLE = {
    "op2_repeated_words": REPEATED_WORDS_SQL,
    "op4_contamination": CONTAMINATION_SQL,
    "op5_repeated_bytes": REPEATED_BYTES_SQL,
    "op6_tool_calls": TOOL_CALLS_SQL,
    "op12_license_scan": LICENSE_SCAN_SQL,
}
