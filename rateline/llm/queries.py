"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP4_SQL, op4_chat_formatting
from .conversation_repair import op11_conversation_repair
from .decontaminate import OP3_SQL, op3_decontamination
from .imatch import op2_document_fingerprints
from .language import op9_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import op7_best_fit_packing
from .lexical_search import OP13_SQL, op13_lexical_search
from .piece_bpe import op12_piece_bpe
from .simhash import op5_simhash_components
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op6_token_counts
from .token_files import op10_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_document_fingerprints,
        op3_decontamination,
        op4_chat_formatting,
        op5_simhash_components,
        op6_token_counts,
        op7_best_fit_packing,
        op8_suffix_dedup,
        op9_language_id,
        op10_token_files,
        op11_conversation_repair,
        op12_piece_bpe,
        op13_lexical_search,
    )
}

#: Only what DuckDB can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op13_lexical_search": OP13_SQL,
}
