"""The queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from tessera.llm.hosts import OP3_SQL, op3_host_rules
from tessera.llm.html import op7_html_extraction
from tessera.llm.media import op2_media_columns
from tessera.llm.mixing import OP9_SQL, op9_mixing
from tessera.llm.packing import op5_packing
from tessera.llm.pii import op10_pii
from tessera.llm.shards import op4_sharding
from tessera.llm.simhash import op8_simhash_near_dedup
from tessera.llm.tokens import op1_token_counts
from tessera.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_media_columns": op2_media_columns,
    "op3_host_rules": op3_host_rules,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
}

SQL: dict[str, str] = {
    "op3_host_rules": OP3_SQL,
    "op9_mixing": OP9_SQL,
}
