"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from febrile.llm.decontaminate import op8_decontaminate
from febrile.llm.hard_negatives import op11_hard_negatives
from febrile.llm.hilbert_shards import op5_hilbert_shards
from febrile.llm.line_clean import op9_line_clean
from febrile.llm.mix_temperature import op2_mix_temperature
from febrile.llm.ngram_join import op4_ngram_join
from febrile.llm.oracle import oracle_sql
from febrile.llm.piece_codec import op12_piece_codec
from febrile.llm.pii_crf import op1_pii_crf
from febrile.llm.source_divergence import op13_source_divergence
from febrile.llm.suffix_dedup import op3_suffix_dedup
from febrile.llm.token_frames import op6_token_frames
from febrile.llm.toxicity import op10_toxicity
from febrile.llm.warc_derive import op7_warc_derive


__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii_crf, op2_mix_temperature, op3_suffix_dedup, op4_ngram_join, op5_hilbert_shards, op6_token_frames,
           op7_warc_derive, op8_decontaminate, op9_line_clean, op10_toxicity, op11_hard_negatives, op12_piece_codec, op13_source_divergence]
    return {f.__name__: f for f in own}
