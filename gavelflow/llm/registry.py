"""Queries of the pipeline operators, and SQL for those that SQL can express."""

from gavelflow.llm import mixing, quality, token_counts
from gavelflow.llm.bpe import op6_byte_bpe
from gavelflow.llm.jaccard_join import op3_jaccard_join
from gavelflow.llm.langid import op10_language_id
from gavelflow.llm.media import op9_media_columns
from gavelflow.llm.mixing import op2_source_mixing
from gavelflow.llm.quality import op5_quality_rules
from gavelflow.llm.secrets import op4_secret_scans
from gavelflow.llm.substring_dedup import op8_substring_dedup
from gavelflow.llm.suffix_dedup import op7_suffix_dedup
from gavelflow.llm.token_counts import op1_token_counts, token_counts_words

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mixing": op2_source_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_language_id": op10_language_id,
    "token_counts_words": token_counts_words,
}
ORACLES = {
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "token_counts_words": token_counts.ORACLE_SQL,
}
