"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

#: Salts over which the rows of one digest are dealt before they meet.
SALTS = 32
#: Rows from which on a class is dealt back by a broadcast; and the most classes that can be so large.
HOT, MOST = 10_000, 100_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the row
    with the largest id stays; null ids are smallest, and of repeated rows with the
    largest id all carry ``kept`` (they are one document).  If all ids of a group are
    null, keep_id is null and every row is kept, as no row can be named.  Columns besides
    the id and the text are ignored; an empty table gives an empty result.

    Three combining steps, each on the digest *and the full text*: within a map task
    (Spark's partial aggregate), among the rows of one (digest, salt), and among the
    salt winners of a digest.  The salt is made of the id and the map task, so that rows of one id, or without
    ids, part as well; a text that fills a third of the table reaches any task as one row per map task or salt.
    What decides is then dealt back to the digests, without texts: classes of over ``hot`` rows by a broadcast,
    which a share of the rows that rises with their number keeps below ``MOST`` classes, all others by a
    shuffle, in which no key has more rows than that.  Rows are dealt back by the digest, and, were two texts
    ever to share one, by a second hash as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id(), F.lit(17)), F.lit(salts)).cast("int")
    local = rows.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    classes = persisted(
        local.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", "keep_id", "group_size", F.xxhash64("text").alias("content")))
    clashes = not classes.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    keys = ["digest"] + ["content"] * clashes
    classes = classes if clashes else classes.drop("content")
    left = (rows.withColumn("content", F.xxhash64("text")) if clashes else rows).select("doc_id", *keys)
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = max(hot, total // MOST)
    large = F.broadcast(classes.where(F.col("group_size") > hot))  # MOST rows at most
    few = classes.where(F.col("group_size") <= hot)
    if large.isEmpty():
        out = left.join(few, keys)
    else:
        out = left.join(large, keys).unionByName(left.join(large.select(*keys), keys, "left_anti").join(few, keys))
    return out.select(
        "doc_id", "keep_id", "group_size", F.expr("keep_id IS NULL OR coalesce(doc_id = keep_id, false)").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
