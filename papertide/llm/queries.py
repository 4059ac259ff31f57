"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, mixing, oracles, urls
from .audit import op11_filter_audit
from .decontaminate import op8_decontamination
from .language import op2_language_id
from .mixing import op6_mixing
from .pieces import op12_sentencepiece
from .pii import op9_pii
from .quality import op1_quality_rules
from .quotations import op5_quotation_linking
from .secrets import op10_secrets
from .simhash import op7_simhash
from .substrings import op4_repeats
from .urls import op3_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_repeats": op4_repeats,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_filter_audit": op11_filter_audit,
    "op12_sentencepiece": op12_sentencepiece,
}

SQL: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op3_url_filters": urls.SQL,
    "op4_repeats": oracles.REPEATS,
    "op5_quotation_linking": oracles.QUOTATIONS,
    "op6_mixing": mixing.SQL,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op11_filter_audit": audit.SQL,
}
