"""The corpus queries and their SQL."""

from __future__ import annotations

from quillon.llm import filter_audit, linededup, secrets, substrings, urlfilter
from quillon.llm.decontam import op2_decontam
from quillon.llm.filter_audit import op13_filter_audit
from quillon.llm.html_extract import op8_html
from quillon.llm.linededup import op6_line_dedup
from quillon.llm.packing import op5_packing
from quillon.llm.pieces import op11_sentencepiece
from quillon.llm.pii import op1_pii
from quillon.llm.quality import op3_quality
from quillon.llm.secrets import op7_secrets
from quillon.llm.simhash import op4_simhash
from quillon.llm.substrings import op10_substrings
from quillon.llm.urlfilter import op9_url_filter
from quillon.llm.whitening import op12_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontam": op2_decontam,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_url_filter": op9_url_filter,
    "op10_substrings": op10_substrings,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op6_line_dedup": linededup.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op10_substrings": substrings.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
