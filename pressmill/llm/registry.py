"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import mixture, oracles
from .ann import op7_additive_quantisation
from .chat import op1_chat_windows
from .decontaminate import op8_decontamination
from .fill_in_middle import op11_fill_in_middle
from .html_text import op3_wrapper_induction
from .jaccard import op9_ngram_jaccard
from .language import op6_language_id
from .licenses import op4_license_scan
from .line_dedup import op12_line_dedup
from .quality import op2_quality_rules
from .secret_scan import op5_secret_scan
from .token_alignment import op13_token_alignment

QUERIES = {
    "op1_chat_windows": op1_chat_windows,
    "op2_quality_rules": op2_quality_rules,
    "op3_wrapper_induction": op3_wrapper_induction,
    "op4_license_scan": op4_license_scan,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_additive_quantisation": op7_additive_quantisation,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixture": mixture.op10_mixture,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_windows": oracles.CHAT,
    "op4_license_scan": oracles.LICENSES,
    "op5_secret_scan": oracles.SECRETS,
    "op9_ngram_jaccard": oracles.JACCARD,
    "op10_mixture": mixture.ORACLE_SQL,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_line_dedup": oracles.LINES,
}
