"""Exact token counts by a histogram of encoded lengths (operator 5).

Every text is encoded once.  The documents are then summed by encoded length; how many have a length says all there is to
know about a context limit.  Sums over the lengths from a limit on give the texts that exceed it, what truncation keeps
and loses, and the quantiles, for every limit at once.  The histogram has a row per source and distinct length, which does
not grow with the number of documents once all lengths occur.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import read

#: Vocabulary file (byte-pair ranks) and the pattern that cuts a text before merging; parameters of everything below.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str = RANKS_PATH):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encoded_length(docs: DataFrame, text: str = "text", path: str = RANKS_PATH) -> DataFrame:
    """``docs`` with ``n_tokens``, the number of tokens of the whole text; null texts have none."""

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in column], index=column.index, dtype="int64")

    return docs.withColumn("n_tokens", run(F.col(text)))


def histogram(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_tokens, docs) of texts that have ``n_tokens``."""
    return counted.groupBy(*keys, "n_tokens").agg(F.count("*").alias("docs"))


def limits(sizes: DataFrame, *keys: str) -> DataFrame:
    """For each context limit that is some text's length, by group:

    docs (of exactly this length), docs_over (longer), tokens_over (all tokens of these), total_docs, total_tokens,
    kept_tokens (all tokens after truncation to the limit), lost_tokens, and share_within: the share of texts not longer
    than the limit, so that the q-quantile of the lengths is the first limit whose share reaches q.
    """
    over = W.partitionBy(*keys).orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    tokens = F.col("docs") * F.col("n_tokens")
    out = sizes.select(
        *keys, "n_tokens", "docs", F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(tokens).over(over), F.lit(0)).alias("tokens_over"),
        F.sum("docs").over(whole).alias("total_docs"), F.sum(tokens).over(whole).alias("total_tokens"))
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    return out.withColumn("kept_tokens", F.col("total_tokens") - lost).withColumn("lost_tokens", lost).withColumn("share_within", (F.col("total_docs") - F.col("docs_over")) / F.col("total_docs"))


def at_limit(table: DataFrame, limit: int, *keys: str) -> DataFrame:
    """(keys, kept_tokens, docs_over) for any limit: between two lengths of texts, each longer text keeps ``limit``."""
    n = F.col("n_tokens")
    return table.groupBy(*keys).agg(
        F.sum(F.least(n, F.lit(limit)) * F.col("docs")).alias("kept_tokens"), F.coalesce(F.sum(F.when(n > limit, F.col("docs"))), F.lit(0)).alias("docs_over"))


def quantile(table: DataFrame, q: float, *keys: str) -> DataFrame:
    """(keys, n_tokens): the smallest length that at least the share ``q`` of the texts do not exceed."""
    return table.where(F.col("share_within") >= q).groupBy(*keys).agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """`limits` of the documents of each source, and of all of them (scope ``all``; source is null there).

    Null and empty texts have length 0.  A null source is a group of its own in scope ``source``.
    """
    docs = read(spark, folder, "documents").select("source", "text")
    sizes = histogram(encoded_length(docs), "source")
    every = F.explode(F.array(F.struct(F.lit("source").alias("scope"), F.col("source").alias("source")), F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("source"))))
    both = sizes.select("n_tokens", "docs", every.alias("of")).groupBy("of.scope", "of.source", "n_tokens").agg(F.sum("docs").alias("docs"))
    return limits(both, "scope", "source")
