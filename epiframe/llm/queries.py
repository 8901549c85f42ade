"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from epiframe.llm.ann import op4_nearest_neighbours
from epiframe.llm.divergence import OP11_ORACLE, op11_source_divergence
from epiframe.llm.gam import op13_quality_classifier
from epiframe.llm.htmltext import op2_main_text
from epiframe.llm.langid import op1_language_id
from epiframe.llm.lines import OP6_ORACLE, op6_line_dedup
from epiframe.llm.mixing import OP9_ORACLE, op9_source_mixing
from epiframe.llm.neardup import op5_minhash_neardup
from epiframe.llm.pieces import op3_pieces
from epiframe.llm.quality import op7_quality_rules
from epiframe.llm.repeats import op10_repeats
from epiframe.llm.vectorcodes import OP12_ORACLE, op12_vector_codes
from epiframe.llm.warc import OP8_ORACLE, op8_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_main_text": op2_main_text,
    "op3_pieces": op3_pieces,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_source_mixing": op9_source_mixing,
    "op10_repeats": op10_repeats,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE: dict[str, str] = {
    "op6_line_dedup": OP6_ORACLE,
    "op8_warc": OP8_ORACLE,
    "op9_source_mixing": OP9_ORACLE,
    "op11_source_divergence": OP11_ORACLE,
    "op12_vector_codes": OP12_ORACLE,
}
