"""The queries of this subpackage and the SQL that each must agree with, where SQL can express it."""

from __future__ import annotations

from orebed.llm.chat_format import OP3_SQL, op3_chat_format
from orebed.llm.decontam import op8_decontamination
from orebed.llm.langid import op1_language_id
from orebed.llm.line_dedup import op2_line_dedup
from orebed.llm.minhash import OP10_SQL, op10_minhash
from orebed.llm.packing import op4_packing
from orebed.llm.quality import op5_quality_rules
from orebed.llm.secret_scan import op9_secret_scan
from orebed.llm.url_filter import op7_url_filter
from orebed.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op10_minhash": OP10_SQL,
}
