"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from telemill.llm.annuli import OP12_SQL, op12_top_k
from telemill.llm.chat import OP4_SQL, op4_chat_formatting
from telemill.llm.dualtree import OP11_SQL, op11_hard_negatives
from telemill.llm.langid import op1_language_id
from telemill.llm.mixing import OP2_SQL, op2_mixing
from telemill.llm.neighbours import op5_nearest
from telemill.llm.packing import op9_packing
from telemill.llm.pii import op3_pii
from telemill.llm.quality import OP10_SQL, op10_quality_rules
from telemill.llm.runs import op13_periodic_runs
from telemill.llm.secrets import op7_secret_scan
from telemill.llm.setjoin import op8_ngram_join
from telemill.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_join": op8_ngram_join,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_k": op12_top_k,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_top_k": OP12_SQL,
}
