"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import persisted

#: Bits of a row's hash that the directory may use.
BITS = 60
#: Text bytes that a shard holds at most.
LIMIT = 64 << 20
#: Shards up to which the directory is broadcast (about 100 bytes each).
MOST = 100_000


def row_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of the id and the text's MD5; null is an id, and a text, of its own."""
    key = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.md5(F.col(text_col)), F.lit("\x00")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, rows, most, one) of rows (h, bytes): a leaf for each shard.

    The hash prefixes of ``width`` bits, some sixteen for each shard that the bytes need, are
    summed first; only prefixes over the limit are split on their next bit, beyond ``width``
    over their own rows.  Leaves are what fits under a parent that does not.  A prefix of which all
    rows have one hash is a leaf too, as no bit parts them; ``one`` marks those over the limit, ``most`` is their largest text.
    """
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    width = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    leaves, rest, low = None, sized, 0
    gathered = lambda b, n, s, m, t: (F.sum(b).alias("bytes"), F.sum(n).alias("rows"), F.max(s).alias("most"), F.min(m).alias("low"), F.max(t).alias("high"))
    while True:
        cells = rest.groupBy(F.shiftright("h", BITS - width).alias("cell")).agg(*gathered("bytes", F.lit(1), "bytes", "h", "h"))
        sums = (
            cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(width))).alias("depth"))
            .withColumn("prefix", F.expr(f"shiftright(cell, cast({width} - depth as int))"))
            .groupBy("depth", "prefix").agg(*gathered("bytes", "rows", "most", "low", "high"))
        )
        sums = persisted(sums.withColumn("one", (F.col("low") == F.col("high")) & (F.col("bytes") > limit)).drop("low", "high"))
        fits = (F.col("bytes") <= limit) | F.col("one")
        over = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        under = sums.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        own = under.where(F.col("depth") == low) if low == 0 else under.where(F.lit(False))
        own = own.drop("parent").unionByName(under.join(over, ["depth", "parent"], "left_semi").drop("parent"))
        leaves = own if leaves is None else leaves.unionByName(own)
        large = sums.where(~fits & (F.col("depth") == width)).select("prefix")
        if width == BITS or large.isEmpty():
            return persisted(leaves)
        rest = rest.withColumn("prefix", F.shiftright("h", BITS - width)).join(large, "prefix", "left_semi").drop("prefix")
        low, width = width, min(BITS, width + 8)


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """All rows and columns, with shard (its bits as text), shard_depth, shard_bytes, shard_rows.

    A shard is a hash prefix: an empty table has none, a table within the limit has the one
    with no bits.  Rows are hashed by their id and text, so the rows of one id, or without one, part.  Rows that agree in
    both have one hash and stand in a shard of their own once it is over the limit; it is then dealt into
    parts that fit, numbered where the rows are and named by a suffix.  So only a single text can exceed the limit.

    A row meets the one entry of its first bits, and picks its leaf from that; beyond ``most`` shards that join
    is a shuffle, which moves each row once.  Null texts have 0 bytes.  Columns named like the added ones are replaced.
    """
    added = ("shard", "shard_depth", "shard_bytes", "shard_rows")
    docs = docs.drop(*added)
    h = row_hash(id_col, text_col)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    leaves = directory(docs.select(h.alias("h"), size.alias("bytes")), limit)
    found = leaves.agg(F.count(F.lit(1)), F.min("depth"), F.max("one")).first()
    if not found[0]:
        return docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(added, ("string", "int", "long", "long"))])
    first = found[1]
    # hashes are even, so that few leaves share their first bits
    table = leaves.groupBy(F.expr(f"shiftright(prefix, cast(depth - {first} as int))").alias("cell")).agg(F.collect_list(F.struct("depth", "prefix", "bytes", "rows", "most", "one")).alias("leaves"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), h.alias("h")).withColumn("cell", F.shiftright("h", BITS - first))
    own = F.expr(f"filter(leaves, x -> shiftright(h, cast({BITS} - x.depth as int)) = x.prefix)[0]")
    placed = rows.join(F.broadcast(table) if found[0] <= most else table, "cell").select("row", own.alias("leaf"))
    bits = F.lpad(F.conv(F.col("leaf.prefix"), 10, 2), F.col("leaf.depth").cast("int"), "0")
    named = lambda df, *c: df.select("row.*", *[x.alias(n) for n, x in zip(added, c)])
    whole = named(placed.where(~F.col("leaf.one") | (F.col("leaf.rows") == 1)) if found[2] else placed, bits, F.col("leaf.depth").cast("int"), F.col("leaf.bytes"), F.col("leaf.rows"))
    if not found[2]:
        return whole
    # rows of one hash are alike: they are numbered within each map task, so none has to hold them all
    alike = placed.where(F.col("leaf.one") & (F.col("leaf.rows") > 1)).withColumn("task", F.spark_partition_id())
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col("leaf.most")))
    group = W.partitionBy("leaf.prefix", "leaf.depth", "task")
    numbered = alike.withColumn("n", F.row_number().over(group.orderBy(F.lit(1)))).withColumn("c", F.count(F.lit(1)).over(group)).withColumn("part", F.floor((F.col("n") - 1) / room))
    part_rows = F.least(room, F.col("c") - F.col("part") * room)
    suffix = F.concat(bits, F.lit("."), F.col("task").cast("string"), F.lit("."), F.col("part").cast("string"))
    return whole.unionByName(named(numbered, suffix, F.col("leaf.depth").cast("int"), F.floor(F.col("leaf.bytes") / F.col("leaf.rows")) * part_rows, part_rows))
