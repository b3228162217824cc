"""Token counts: the whole-token shortcut.

A vocabulary string that is a pre-token by itself and that the merges turn into one token counts 1 wherever it occurs
as a pre-token; this is proven for every string of the vocabulary before the first text is read. Only other pre-tokens
are merged, each distinct one once while a worker remembers it. The plan is one scan with one Arrow UDF: no shuffle.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and rows with a null id give a row each;
an empty table gives no rows; further columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_tokenizer, table, texts_of


def n_tokens(text: Column, vocabulary: str = "byte_bpe_50k.json", path: str | None = None) -> Column:
    """Tokens of each text as the tokenizers library gives them, without added begin and end. path: the vocabulary's
    file on the executors; by default the public file of that name."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .bpe import piece_table

        pieces = piece_table(path or default_tokenizer(vocabulary), "counts")
        for texts in batches:
            yield pa.array([pieces.value(t) for t in texts_of(texts)], pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "long")(text)


def token_counts(docs: DataFrame, limit: int = 512, **tokenizer: str) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, **tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
