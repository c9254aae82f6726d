"""The numbered queries of this folder and, where SQL can express them, their SQL."""

from tidemark.llm.chat_rotation import OP6_SQL, op6_chat_rotation
from tidemark.llm.decontaminate import OP4_SQL, op4_decontaminate
from tidemark.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from tidemark.llm.language_id import op10_language_id
from tidemark.llm.mixing import OP3_SQL, op3_mix_sources
from tidemark.llm.ngram_jaccard import op2_ngram_jaccard
from tidemark.llm.private_data import OP5_SQL, op5_private_data
from tidemark.llm.substring_dedup import OP1_SQL, op1_sentence_runs
from tidemark.llm.suffix_dedup import op7_suffix_dedup
from tidemark.llm.token_files import op8_token_files

QUERIES = {
    "op5_private_data": op5_private_data,
    "op6_chat_rotation": op6_chat_rotation,
    "op3_mix_sources": op3_mix_sources,
    "op4_decontaminate": op4_decontaminate,
    "op1_sentence_runs": op1_sentence_runs,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}
SQL = {"op5_private_data": OP5_SQL, "op6_chat_rotation": OP6_SQL, "op3_mix_sources": OP3_SQL, "op4_decontaminate": OP4_SQL, "op1_sentence_runs": OP1_SQL, "op9_exact_dedup": OP9_SQL}
