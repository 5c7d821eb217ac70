"""One query for each text operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import alignment, bpe, centroids, decontaminate, html_text, jaccard, lattice, quality, secrets, substrings, token_counts, toxicity, warc
from .common import table
from .oracles import SQL  # noqa: F401

QUERIES = {
    "op1_lattice_likelihood": lambda spark, d: lattice.op1_lattice_likelihood(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op2_quality_rules": lambda spark, d: quality.op2_quality_rules(table(spark, d, "documents")),
    "op3_ngram_jaccard": lambda spark, d: jaccard.near_duplicates(table(spark, d, "documents")),
    "op4_html_extraction": lambda spark, d: html_text.extract(table(spark, d, "pages")),
    "op5_decontamination": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_token_counts": lambda spark, d: token_counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op7_substring_dedup": lambda spark, d: substrings.op7_substring_dedup(table(spark, d, "documents")),
    "op8_secret_scans": lambda spark, d: secrets.op8_secret_scans(table(spark, d, "documents")),
    "op9_bpe": lambda spark, d: bpe.op9_bpe(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op10_toxicity": lambda spark, d: toxicity.op10_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_warc": lambda spark, d: warc.op11_warc(table(spark, d, "pages")),
    "op12_yinyang": lambda spark, d: centroids.yinyang(table(spark, d, "embeddings")),
    "op13_alignment": lambda spark, d: alignment.op13_alignment(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
}
