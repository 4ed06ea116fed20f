"""Suggestions for an empty input: merge, ids, lookup. Rows are (key, value, type, ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .dictionary import string_pool

def _key():
    return W.partitionBy("key")


def _not_ascii(df: DataFrame) -> DataFrame:
    return df.where(~X.is_ascii(F.col("key")))


def _few(df: DataFrame, most: int) -> DataFrame:
    """Whole keys with at most so many entries."""
    return df.withColumn("__n", F.count(F.lit(1)).over(_key())).where(F.col("__n") <= most).drop("__n")


def _first(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(_key().orderBy("ord"))).where(F.col("__n") <= most).drop("__n")


def merged(rules: DataFrame, emoji: DataFrame, emoticons: DataFrame, symbols: DataFrame, custom: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(key, value, type, src_rank, ord, place): rules, emoji, emoticons, symbols, then custom entries of each key.

    Only rules (and custom entries) may have ASCII keys. Emoji and symbol keys with over ``most``
    entries go whole, emoticons keep their first ``most``. A custom value that its key already has goes;
    values that the other sources repeat stay.
    """
    parts = [rules, _few(_not_ascii(emoji), most), _first(_not_ascii(emoticons), most), _few(_not_ascii(symbols), most), *([custom] if custom is not None else [])]
    every = reduce(DataFrame.unionByName, [p.select("key", "value", "type", "ord", F.lit(i).alias("src_rank")) for i, p in enumerate(parts)])
    order = F.row_number().over(W.partitionBy("key", "value").orderBy("src_rank", "ord"))
    kept = every.withColumn("__n", order).where((F.col("src_rank") < 4) | (F.col("__n") == 1)).drop("__n")
    return kept.withColumn("place", F.row_number().over(_key().orderBy("src_rank", "ord")))


def tokens(entries: DataFrame) -> DataFrame:
    """(key_id, value_id, type, place) over one pool of strings in code-point order."""
    pool = string_pool(entries, "key", "value")
    key, value = (pool.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id")) for c in ("key", "value"))
    return entries.join(key, "key").join(value, "value").select("key_id", "value_id", "type", "place")


def lookup(entries: DataFrame, keys: DataFrame, on: str = "key") -> DataFrame:
    """(key, place, value, type) of the asked keys; a key without entries has no row."""
    return entries.join(keys.select(F.col(on).alias("key")).distinct(), "key", "left_semi").select("key", "place", "value", "type")


def audit(entries: DataFrame) -> DataFrame:
    """(key, value, type) in key and place order, for a TSV."""
    return entries.orderBy("key", "place").select("key", "value", "type")
