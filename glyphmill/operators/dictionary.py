"""Merging, filtering, grouping and encoding of dictionary rows (yomi, left_id, right_id, cost, tango, src, ord)."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set if need be; on a cluster ``spark.checkpoint.dir`` has to name it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``; one of this machine is taken only where that is unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def union_ranked(*sources: DataFrame) -> DataFrame:
    """All rows of the sources with src_rank, the place of their source; order is (src_rank, ord)."""
    return reduce(DataFrame.unionByName, [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)])


def without_rules(rows: DataFrame, rules: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Rows that no rule matches. A rule names ``on`` and any of ``columns``; null ones match everything.

    One anti join on the named column; the wildcards are a condition on the pairs that meet there.
    """
    r = rules.select(*[F.col(c).alias(f"__{c}") for c in (on, *columns)])
    hit = reduce(Column.__and__, [F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)) for c in columns], F.col(on) == F.col(f"__{on}"))
    return rows.join(r, hit, "left_anti")


def missing(rows: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which the keys are not in the base."""
    return rows.join(base.select(*keys), keys, "left_anti")


def group_ordered(rows: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """(key, entries): the fields of each key's rows as structs in the given order; a key's rows are one row, which has to fit a task."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("entry"))))
    return rows.groupBy(key).agg(F.transform(packed, lambda x: x["entry"]).alias("entries"))


def by_length(df: DataFrame, column: str = "yomi") -> DataFrame:
    """Sorted by UTF-16 length, then UTF-16 order."""
    return df.orderBy(X.utf16_length(F.col(column)), X.utf16_order(F.col(column)))


def first_seen_ids(rows: DataFrame, keys: list[str], order: Column | str, name: str = "id") -> DataFrame:
    """Dense ids of the distinct keys: the key first seen last has 0, of those first seen together the least key.

    The keys are aggregated, then numbered by ranges.
    """
    seen = rows.groupBy(*keys).agg(F.min(order).alias("__first"))
    return ranked(seen, [F.desc("__first"), *keys], name).drop("__first").withColumn(name, F.col(name).cast("int"))


def encoded(rows: DataFrame, ids: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Rows with the id of their keys; a key without one is an error when its row is read."""
    out = rows.join(ids.select(*keys, name), keys, "left")
    return out.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"no {name} for a key of the rows")).cast("int")))


def cheapest(rows: DataFrame, keys: list[str], cost: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the one with the least cost, ties to the first in order."""
    w = W.partitionBy(*keys).orderBy(cost, *order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def string_pool(df: DataFrame, *columns: str) -> DataFrame:
    """(value, id): the distinct values of the columns in code-point order, from 0."""
    all_values = reduce(DataFrame.union, [df.select(F.col(c).alias("value")) for c in columns])
    return ranked(all_values.where("value IS NOT NULL").distinct(), "value", "id")


#: Rows that a range of a numbering holds, about.
RANGE = 100_000


def ranked(distinct: DataFrame, order: str | list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Dense ranks from 0 over rows of which the order is distinct: ranges are counted, then numbered one by one.

    No window runs over all rows: a window within each range, one over the ranges' counts.  The
    rows are kept in their ranges by a checkpoint, as both the counts and the numbers need the same ones.  So
    this runs jobs when it is called: a count, unless ``parts`` says how many ranges to make, and the checkpoint.
    """
    by = [order] if isinstance(order, str) else order
    if parts is None:
        distinct = checkpointed(distinct)
        parts = -(-distinct.count() // RANGE) or 1
    ranged = checkpointed(distinct.repartitionByRange(parts, *by).withColumn("__p", F.spark_partition_id()))
    inner = ranged.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*by)))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # a row for each range
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return inner.join(F.broadcast(before), "__p").withColumn(name, F.col("__n") + F.col("__b") - 1).drop("__p", "__n", "__b")


def token_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """(key_id, pair_id, cost, surface_kind, surface, ...order): every row by the ids of its reading and context pair.

    Readings are numbered by length, then letters; pairs by ``first_seen_ids`` over the rows in the order of their
    readings, then ``order``.  Surfaces that the reading gives again (kana) are left out: null.
    """
    kind = X.surface_kind(F.col("yomi"), F.col("tango"))
    keys = ranked(rows.select("yomi").distinct(), [X.utf16_length(F.col("yomi")), X.utf16_order(F.col("yomi"))], "key_id")
    keyed = rows.join(keys, "yomi")
    pairs = first_seen_ids(keyed, ["left_id", "right_id"], F.struct("key_id", *order), "pair_id")
    out = encoded(keyed, pairs, ["left_id", "right_id"], "pair_id").withColumn("surface_kind", kind)
    return out.select("key_id", "pair_id", "cost", "surface_kind", F.when(F.col("surface_kind") == "text", F.col("tango")).alias("surface"), *order)


def lookup(words: DataFrame, column: str, keys: DataFrame, key: str = "yomi", most: int = 64) -> DataFrame:
    """(word, id, begins) of the different words: the id of the key that equals one, null if none does, and whether a key of up to ``most`` letters begins with it.

    Both are equi joins, the second one on the beginnings of the keys; a word longer than ``most`` begins no key.
    """
    asked = words.select(F.col(column).alias("word")).where("word IS NOT NULL").distinct()
    ids = ranked(keys.select(F.col(key).alias("word")).where("word IS NOT NULL").distinct(), "word", "id")
    heads = ids.where(F.length("word") <= most).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("word")).distinct()
    return asked.join(ids, "word", "left").join(heads.withColumn("begins", F.lit(True)), "word", "left").withColumn("begins", F.coalesce("begins", F.lit(False)))


def restored(ids: DataFrame, column: str, keys: DataFrame, key: str = "yomi") -> DataFrame:
    """(id, word) of the different ids: the key that has the id in ``lookup``, null if none has."""
    known = ranked(keys.select(F.col(key).alias("word")).where("word IS NOT NULL").distinct(), "word", "id")
    return ids.select(F.col(column).alias("id")).distinct().join(known, "id", "left").select("id", "word")


def front_coded(df: DataFrame, column: str, block: int = 16) -> DataFrame:
    """(id, value, block, shared, rest): each value but a block's first without the bytes it shares with the one before."""
    ids = ranked(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct(), "value", "id")
    w = W.partitionBy("block").orderBy("id")
    coded = ids.withColumn("block", F.floor(F.col("id") / block)).withColumn("b", F.encode("value", "UTF-8")).withColumn("before", F.lag("b").over(w))
    return coded.withColumn("shared", X.common_prefix(F.col("b"), F.col("before"))).select("id", "value", "block", "shared", F.expr("hex(substring(b, shared + 1))").alias("rest"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts: entries, distinct readings, surfaces and pairs, readings with one and more entries, extremes of the readings' UTF-16 lengths and of the costs; 0 on empty."""
    per = rows.groupBy("yomi").agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    b = rows.agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("tango").alias("surfaces"), F.countDistinct("yomi", "tango").alias("pairs"),
        zero(F.min(X.utf16_length(F.col("yomi")))).alias("min_length"), zero(F.max(X.utf16_length(F.col("yomi")))).alias("max_length"), zero(F.min("cost")).alias("min_cost"), zero(F.max("cost")).alias("max_cost"))
    return a.join(b)  # two single rows


def write(rows: DataFrame, path: str, kana_column: bool = True) -> None:
    """The dictionary as Parquet sorted by reading within ranges, so that lookups skip row groups."""
    out = rows.withColumn("surface_kind", X.surface_kind(F.col("yomi"), F.col("tango"))) if kana_column else rows
    out.repartitionByRange("yomi").sortWithinPartitions("yomi", "src_rank" if "src_rank" in rows.columns else "ord", "ord").write.mode("overwrite").parquet(path)
