"""The operators' queries over the driver tables, and their SQL counterparts."""

from __future__ import annotations

from tessera.llm import decontamination
from tessera.llm.decontamination import op7_decontamination
from tessera.llm.html import op5_html
from tessera.llm.langid import op10_language
from tessera.llm.neighbours import op8_neighbours
from tessera.llm.packing import op4_packing
from tessera.llm.sharding import op9_sharding
from tessera.llm.simhash import op3_simhash
from tessera.llm.suffixes import op2_suffixes
from tessera.llm.tokenfiles import op6_token_files
from tessera.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffixes": op2_suffixes,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_html": op5_html,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_neighbours": op8_neighbours,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {
    "op7_decontamination": decontamination.ORACLE,
}
