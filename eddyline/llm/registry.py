"""The registered corpus queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from eddyline.llm.byte_bpe import op6_byte_bpe
from eddyline.llm.byte_cnn import op4_byte_cnn
from eddyline.llm.exact_whitening import op13_exact_whitening
from eddyline.llm.fast_similarity import OP12_SQL, op12_fast_similarity
from eddyline.llm.feistel_pseudonyms import op3_feistel_pseudonyms
from eddyline.llm.ngram_join import OP9_SQL, op9_ngram_join
from eddyline.llm.pigeonhole import op2_pigeonhole
from eddyline.llm.ordinal_toxicity import op7_ordinal_toxicity
from eddyline.llm.quartile_digest import op10_quartile_digest
from eddyline.llm.residue_negatives import OP11_SQL, op11_residue_negatives
from eddyline.llm.secret_battery import op1_secret_battery
from eddyline.llm.suffix_dedup import OP5_SQL, op5_suffix_dedup
from eddyline.llm.warc_bundles import OP8_SQL, op8_warc_bundles

OPERATORS = (
    op1_secret_battery,
    op2_pigeonhole,
    op3_feistel_pseudonyms,
    op4_byte_cnn,
    op5_suffix_dedup,
    op6_byte_bpe,
    op7_ordinal_toxicity,
    op8_warc_bundles,
    op9_ngram_join,
    op10_quartile_digest,
    op11_residue_negatives,
    op12_fast_similarity,
    op13_exact_whitening,
)
SQL = {
    "op5_suffix_dedup": OP5_SQL,
    "op8_warc_bundles": OP8_SQL,
    "op9_ngram_join": OP9_SQL,
    "op11_residue_negatives": OP11_SQL,
    "op12_fast_similarity": OP12_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return dict(SQL)
