"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm.ann import op2
from lumenlog.llm.common import table
from lumenlog.llm.fingerprints import op3
from lumenlog.llm.html_text import main_text
from lumenlog.llm.packing import op8
from lumenlog.llm.pieces import op5
from lumenlog.llm.pii import op6
from lumenlog.llm.quality import op10
from lumenlog.llm.simhash import op7
from lumenlog.llm.suffix_dedup import op4
from lumenlog.llm.toxicity import op9

#: Where the public vocabulary files are; read in place, never copied.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": lambda s, d: main_text(table(s, d, "pages")),
        "op2_nearest": lambda s, d: op2(table(s, d, "embeddings")),
        "op3_fingerprints": lambda s, d: op3(table(s, d, "documents")),
        "op4_suffix_dedup": lambda s, d: op4(table(s, d, "documents")),
        "op5_sentencepiece": lambda s, d: op5(table(s, d, "documents"), PIECE_BPE),
        "op6_pii": lambda s, d: op6(table(s, d, "documents")),
        "op7_simhash_dedup": lambda s, d: op7(table(s, d, "documents")),
        "op8_packing": lambda s, d: op8(table(s, d, "documents"), BYTE_BPE),
        "op9_toxicity": lambda s, d: op9(table(s, d, "documents"), table(s, d, "labels")),
        "op10_quality": lambda s, d: op10(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
