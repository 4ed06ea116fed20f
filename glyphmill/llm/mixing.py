"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import persisted, split_words

#: Tokens (words) that a block of a source holds on average.
BLOCK = 1 << 16
#: Cells that a source is hashed into at least, and rows for each further cell; blocks are sets of cells.
CELLS, CELL_ROWS = 1 << 20, 64
#: Blocks, or sources, up to which their table is broadcast (about 80 bytes each).
MOST = 200_000


def temperature(tokens: dict, exponent: float, many: dict | None = None) -> dict:
    """Weights in proportion to the token shares to the power of the exponent; ``many`` sources may stand behind a key."""
    most = max(tokens.values(), default=0)  # as shares of the largest, which no exponent lets vanish
    raw = {s: (n / most) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = math.fsum(x * (many[s] if many else 1) for s, x in raw.items())
    return {s: x / norm if norm else 0.0 for s, x in raw.items()}


def entropy(weights: dict, many: dict | None = None) -> float:
    return -math.fsum(w * math.log(w) * (many[s] if many else 1) for s, w in weights.items() if w)


def repeats(tokens: dict, weights: dict, budget: float | None) -> dict:
    """How often each source is passed through; without a budget the least one that covers every source once."""
    ratio = {s: weights[s] / n for s, n in tokens.items() if n}
    if budget is None:
        least = min(ratio.values(), default=1.0)
        if not least:
            raise ValueError("a source's weight vanishes, so no budget takes it whole; give a budget")
        return {s: ratio[s] / least if n else 1.0 for s, n in tokens.items()}  # x / x is 1 exactly
    return {s: ratio[s] * budget if n else 1.0 for s, n in tokens.items()}


def bisect_exponent(tokens: dict, budget: float | None = None, max_repeats: float | None = None, target_entropy: float | None = None, many: dict | None = None) -> float:
    """The exponent that meets the target: 0 is even weights, 1 the natural shares, more favours large sources.

    ``max_repeats``: the least exponent in [0, 1] by which no source is passed through more
    often; 1 where the budget needs more repeats, as no other exponent needs fewer.
    ``target_entropy`` (nats): the exponent whose weights have that entropy, which falls as
    the exponent grows; 0 for more than even weights have.  A target that no exponent reaches is refused.
    """
    tokens = {s: n for s, n in tokens.items() if n}
    if not tokens:
        return 1.0
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")

    def flat_enough(a: float) -> bool:  # true from some exponent on
        w = temperature(tokens, a, many)
        return max(repeats(tokens, w, budget).values()) <= max_repeats if max_repeats is not None else entropy(w, many) <= target_entropy

    low, high = 0.0, 1.0
    if target_entropy is not None and target_entropy <= math.log(sum(many[s] if many else 1 for s, n in tokens.items() if n == max(tokens.values()))) and len(set(tokens.values())) > 1:
        raise ValueError("no exponent reaches so low an entropy")  # the largest sources alone, evenly, are the limit
    if flat_enough(low):
        return low
    if max_repeats is not None and not flat_enough(high):
        return high
    while not flat_enough(high):
        if high > 2.0**64:
            raise ValueError("no exponent reaches so low an entropy")
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if flat_enough(mid) else (mid, high)
    return high


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST else df


def cell_count(docs: DataFrame) -> int:
    """Cells of a source: a power of two that gives a cell some ``CELL_ROWS`` rows in the largest tables, so that blocks stay small."""
    return max(CELLS, 1 << max(0, (docs.count() // CELL_ROWS).bit_length()))


def _cell(cells: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(cells))


def plan(docs: DataFrame, budget: float | None, max_repeats: float | None, target_entropy: float | None, block: int, seed: int):
    """(plan of blocks, report by source, cells of a source).

    The plan is a row for each (source, block): its tokens, its rank-free place in the
    source's permutation, and the whole passes and the extra pass that the budget gives it.
    """
    spark = docs.sparkSession
    n = F.size(split_words(F.col("text"))).cast("long")
    cells_each = cell_count(docs)
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), _cell(cells_each, seed).alias("cell"), n.alias("n_tokens"))
    # fine cells of a source are summed in one pass over the texts; blocks are whole cells
    cells = persisted(rows.groupBy("mix_source", "cell").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("rows")))
    sources = persisted(cells.groupBy("mix_source").agg(F.sum("n_tokens").alias("source_tokens")))
    # sources with equal counts have equal weights: the driver gets each different count once
    many = {r["source_tokens"]: r["m"] for r in sources.groupBy("source_tokens").agg(F.count(F.lit(1)).alias("m")).collect()}
    tokens = {k: k for k in sorted(many)}
    exponent = bisect_exponent(tokens, budget, max_repeats, target_entropy, many)
    weights = temperature(tokens, exponent, many)
    times = repeats(tokens, weights, budget)
    by_count = spark.createDataFrame(
        [(k, float(weights[k]), float(times[k]), max(1, min(cells_each, -(-k // block))), float(exponent)) for k in tokens],
        "source_tokens long, weight double, times double, n_blocks long, exponent double")
    report = persisted(sources.join(_side(by_count), "source_tokens"))
    blocks = (
        cells.join(_side(report.select("mix_source", "n_blocks")), "mix_source")
        .groupBy("mix_source", F.pmod("cell", "n_blocks").alias("block")).agg(F.sum("n_tokens").alias("n_tokens"))
        # the permutation orders blocks by this key; its first digits part a source's blocks into groups of bounded size
        .withColumn("key", F.pmod(F.xxhash64("mix_source", "block", F.lit(seed)), F.lit(1 << 40)))
        .join(_side(report.select("mix_source", "times", "n_blocks", "source_tokens")), "mix_source")
        .withColumn("group", F.floor(F.col("key") / F.ceil(F.lit(float(1 << 40)) / F.ceil(F.col("n_blocks") / 4096.0))))
    )
    groups = blocks.groupBy("mix_source", "group").agg(F.sum("n_tokens").alias("g"))
    before = groups.withColumn("before", F.coalesce(F.sum("g").over(W.partitionBy("mix_source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("g")
    inner = W.partitionBy("mix_source", "group").orderBy("key", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        blocks.join(before, ["mix_source", "group"])
        .withColumn("offset", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .withColumn("whole", F.floor("times").cast("int"))
        .withColumn("extra", F.col("offset") < (F.col("times") - F.floor("times")) * F.col("source_tokens"))
        .withColumn("passes", F.col("whole") + F.col("extra").cast("int"))
        .select("mix_source", "block", "offset", "passes", (F.col("offset") / F.greatest(F.col("source_tokens"), F.lit(1)) / F.col("times")).alias("at"), (F.lit(1.0) / F.col("times")).alias("pass_width"))
    )
    return persisted(placed), report, cells_each


def mixed(docs: DataFrame, budget: float | None = None, max_repeats: float | None = None, target_entropy: float | None = None, block: int = BLOCK, seed: int = 11, marks: bool = True) -> DataFrame:
    """The documents as often as the mix takes them, all columns, with mix_epoch, mix_block and mix_at (unless ``marks`` is false).

    Tokens are words here.  The result is not sorted.  Weights are the sources' token shares to a power, found by bisection to
    meet ``max_repeats`` (default 2) or ``target_entropy``.  ``budget`` is the number of tokens to realise; without
    one it is the least that takes every source whole at least once, so no document is lost.
    A source is dealt into blocks by a hash of doc_id and text; each pass goes through its blocks in one
    permutation, and the last, partial pass takes blocks while they begin within the budget, so a
    source overshoots by less than a block.  ``mix_at`` in [0, 1) is the block's place in its
    source's budget: ordering by it interleaves the sources by their weights.

    A null source counts as ''; null and repeated ids are rows like others; a source without
    tokens is passed through once; an empty table gives an empty result.  Blocks are about even,
    whatever share of the rows a source has, so the join with the plan has no hot key; only rows
    that agree in both always share a block.
    """
    if max_repeats is None and target_entropy is None:
        max_repeats = 2.0
    if marks:
        docs = docs.drop("mix_epoch", "mix_block", "mix_at")
    placed, report, cells_each = plan(docs, budget, max_repeats, target_entropy, block, seed)
    small = placed.count() <= MOST
    sources = _side(report.select("mix_source", "n_blocks"))
    keyed = (
        # the row is one column from here on, so that its names cannot clash
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), _cell(cells_each, seed).alias("cell"))
        .join(sources, "mix_source").withColumn("block", F.pmod("cell", "n_blocks"))
    )
    out = keyed.join(F.broadcast(placed) if small else placed, ["mix_source", "block"]).where("passes > 0")
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return out.select("row.*") if not marks else out.select(
        "row.*", "mix_epoch", F.col("block").alias("mix_block"), (F.col("at") + F.col("mix_epoch") * F.col("pass_width")).alias("mix_at"))
