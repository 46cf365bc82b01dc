"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from parqsieve.llm.chat import OP10_SQL, op10_chat_perspectives
from parqsieve.llm.decontaminate import OP2_SQL, op2_decontamination
from parqsieve.llm.embeddings import OP8_SQL, op8_embeddings
from parqsieve.llm.html_crf import op3_html_extraction
from parqsieve.llm.minhash import OP6_SQL, op6_minhash
from parqsieve.llm.packing import op9_packing
from parqsieve.llm.suffixes import OP5_SQL, op5_suffix_dedup
from parqsieve.llm.tokens import op1_token_counts
from parqsieve.llm.toxicity import op7_toxicity
from parqsieve.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_decontamination, op3_html_extraction, op4_warc, op5_suffix_dedup, op6_minhash, op7_toxicity, op8_embeddings, op9_packing, op10_chat_perspectives)
}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op4_warc": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op6_minhash": OP6_SQL, "op8_embeddings": OP8_SQL, "op10_chat_perspectives": OP10_SQL}
