"""Contract queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from tidewatch.llm.byte_bpe import op2_byte_bpe
from tidewatch.llm.chat import OP12_SQL, op12_chat
from tidewatch.llm.html_text import op5_host_paths
from tidewatch.llm.merkle import OP11_SQL, op11_merkle
from tidewatch.llm.mixing import OP10_SQL, op10_mixing
from tidewatch.llm.quality_model import op7_quality_qda
from tidewatch.llm.quality_rules import OP8_SQL, op8_quality_rules
from tidewatch.llm.secrets import op3_secret_scan
from tidewatch.llm.simhash import op9_simhash
from tidewatch.llm.spelling import OP13_SQL, op13_spelling
from tidewatch.llm.token_files import op1_token_planes
from tidewatch.llm.topk import OP6_SQL, op6_topk
from tidewatch.llm.warc import OP4_SQL, op4_warc_chunks

QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc_chunks": op4_warc_chunks,
    "op5_host_paths": op5_host_paths,
    "op6_topk": op6_topk,
    "op7_quality_qda": op7_quality_qda,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op4_warc_chunks": OP4_SQL,
    "op6_topk": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op12_chat": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
