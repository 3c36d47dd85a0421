"""The queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from leafwork.llm.bpe import op7_byte_bpe
from leafwork.llm.chat import op10_chat
from leafwork.llm.embedding_dedup import op8_embedding_dedup
from leafwork.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from leafwork.llm.mixing import OP9_SQL, op9_mixing
from leafwork.llm.near_dedup import op5_near_dedup
from leafwork.llm.pii import op3_pii
from leafwork.llm.quality_classifier import op6_quality_classifier
from leafwork.llm.quality_rules import OP4_SQL, op4_quality_rules
from leafwork.llm.resampling import OP13_SQL, op13_resampling
from leafwork.llm.sharding import OP2_SQL, op2_sharding
from leafwork.llm.spelling import OP11_SQL, op11_spelling_variants
from leafwork.llm.token_counts import op1_token_counts

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_pii, op4_quality_rules, op5_near_dedup, op6_quality_classifier, op7_byte_bpe, op8_embedding_dedup, op9_mixing, op10_chat, op11_spelling_variants, op12_exact_dedup, op13_resampling)}
SQL = {"op2_sharding": OP2_SQL, "op4_quality_rules": OP4_SQL, "op9_mixing": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_resampling": OP13_SQL}
