"""All queries of this subpackage, and the pipeline over its operators."""

import corpus_pipeline
from ratingloom.llm import (  # noqa: F401
    byte_bpe, four_russians, hierarchical_quality, imatch, language_id, license_inheritance, mtree_search, ngram_join, presence_masks, secret_ledger, template_decontamination,
    token_files, toxic_sentences,
)
from ratingloom.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
