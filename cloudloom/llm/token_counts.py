"""Token counts by byte-pair merging on a heap and a linked list.

Cases: null and empty texts count 0 tokens and 0 bytes; a text of any length is counted whole; equal
texts and repeated rows give equal counts in a row each; an empty table gives an empty table; other
columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.bpe import merger
from cloudloom.llm.common import pieces


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of ``text`` under the byte-level BPE file ``vocabulary`` (a path that every executor has)."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = merger(vocabulary)
        # the merger's tables stay for the next task, whose words are mostly the same; their size is bounded
        for batch in batches:
            yield pa.array([n for _, texts in pieces(batch) for n in m.counts(texts)], pa.int64())

    return counted(text)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """A row per row of ``df``: the id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``. No shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
    return slim.withColumn("over_limit", F.col("n_tokens") > limit)
