"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Only DataFrame functions: texts, windows and hits stay in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN, persisted, split_words, words

#: Words in a window, and words of a text that are looked at together.
SIZE, CHUNK = 10, 512
#: Anchor hashes, n-grams, (n-gram, item) pairs and hit texts up to which a side is broadcast (up to about 100 bytes
#: each); larger sides are joined by a shuffle, with the same result.
MOST = 200_000
#: Anchor hashes are plain numbers, of which so many times more are broadcast (some 60 bytes each).
PLAIN = 5


def benchmark_ngrams(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, n, item): the distinct windows of every item; gram is the words joined by blanks, item the id as a string."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    n = F.least(F.size("w"), F.lit(size))
    gram = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return rows.where(F.size("w") > 0).select("item", n.alias("n"), F.explode(F.array_distinct(gram)).alias("gram")).distinct().select("gram", "n", "item")


def _anchor(n: int) -> int:
    """Words of an anchor: every window of n words holds a whole one that begins at a multiple of its length."""
    return (n + 1) // 2


def _side(df: DataFrame, most: int) -> DataFrame:
    """A hash table for every executor if its rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def digest(text: Column) -> Column:
    """What texts are matched by: 128 bits of the whole text; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text", most: int = MOST) -> DataFrame:
    """(th, hits, items) of every different text with a hit: its digest, sorted positions from 1 of hit words, sorted item ids.

    One pass over the documents, for a benchmark of any size.  The aligned anchors of a
    text's words meet the hash set of all anchors of the benchmark's n-grams, which is broadcast
    while it has up to ``PLAIN * most`` entries.  Only where one is found are the windows around it compared, on
    the words themselves, so that a chance hit of hashes does not count; only those windows are shuffled, without
    the text.  For a larger benchmark every anchor of the texts is shuffled, with the few words that windows around it hold.  A long text is looked at in chunks, so that its hits do not carry it along.  Both sides fold A-Z alone, free of context.
    """
    grams = persisted(benchmark_ngrams(benchmark, size))
    distinct = grams.select("gram", "n").distinct()
    sizes = sorted(r["n"] for r in distinct.select("n").distinct().collect())  # at most ``size`` numbers
    if not sizes:
        return docs.select(digest(F.col(text_col)).alias("th"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items")).where(F.lit(False))
    gram_words, b = F.split("gram", " "), F.floor((F.col("n") + 1) / 2).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - b), lambda i: F.xxhash64(F.col("n"), F.slice(gram_words, i + 1, b)))
    anchors = persisted(distinct.select(F.explode(hashed).alias("hash")).distinct())
    # chunks overlap by a window less one word, so that each window lies whole in the chunk in which it begins
    base = docs.select(digest(F.col(text_col)).alias("th"), words(F.col(text_col)).alias("w"))
    # outer explodes: for others Spark makes the whole array twice, to drop rows where it is empty
    chunk = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(w) - 1) div {CHUNK} as int)")), lambda c: F.struct((c * CHUNK).alias("o"), F.slice("w", c * CHUNK + 1, F.lit(CHUNK + size - 1)).alias("w")))
    chunks = base.select("th", F.explode_outer(chunk).alias("c")).select("th", "c.o", "c.w")
    # anchors are told by their place: the size of the window and the number of the anchor, for all sizes in turn
    each = [F.when(F.size("w") >= n, F.floor(F.size("w") / _anchor(n)).cast("int")).otherwise(0) for n in sizes]
    total = reduce(Column.__add__, each)
    placed = chunks.select("th", "o", "w", F.explode_outer(F.when(total > 0, F.sequence(F.lit(0), total - 1))).alias("p"))
    n_of, j_of, before = F.lit(0), F.lit(0), F.lit(0)
    for n, m in zip(sizes, each):
        n_of, j_of = F.when(F.col("p") >= before, n).otherwise(n_of), F.when(F.col("p") >= before, F.col("p") - before).otherwise(j_of)
        before = before + m
    placed = placed.select("th", "o", "w", n_of.alias("n"), j_of.alias("j")).withColumn("b", F.expr("cast((n + 1) div 2 as int)"))
    # a hash of single words, nulls left out, equals that of the slice that they make; it runs in generated code, and is never null
    word = [f"if({k} < b, get(w, j * b + {k}), null)" for k in range(_anchor(sizes[-1]))]
    placed = placed.withColumn("hash", F.expr(f"xxhash64(n, {', '.join(word)})"))

    def around(rows: DataFrame) -> DataFrame:
        """(th, hash, n, at, part) of anchors: the words of the windows that hold it, the first of them the text's word ``at``."""
        first, last = F.greatest(F.lit(1), F.col("j") * F.col("b") + 1 - (F.col("n") - F.col("b"))), F.least(F.col("j") * F.col("b") + 1, F.size("w") - F.col("n") + 1)
        return rows.where((F.col("n") > 0) & (first <= last)).select("th", "hash", "n", (F.col("o") + first).alias("at"), F.slice("w", first, last - first + F.col("n")).alias("part"))

    if anchors.count() <= PLAIN * most:
        probed = around(placed.join(F.broadcast(anchors), "hash", "left_semi"))
    else:  # an anchor is shuffled with the words around it, never with its chunk
        probed = around(placed).join(anchors, "hash", "left_semi")
    window = F.transform(F.sequence(F.lit(0), F.size("part") - F.col("n")), lambda i: F.struct((F.col("at") + i).alias("at"), F.array_join(F.slice("part", i + 1, F.col("n")), " ").alias("gram")))
    windows = probed.select("th", "n", F.explode(window).alias("p")).select("th", "n", "p.*")
    # n is part of the key: the words of two windows of different sizes cannot be the same
    found = persisted(windows.join(_side(distinct, most), ["gram", "n"], "left_semi").distinct())
    places = found.groupBy("th").agg(F.collect_set(F.struct("at", "n")).alias("at")).select(
        "th", F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1))))).alias("hits"))
    items = found.select("th", "gram").distinct().join(_side(grams.select("gram", "item"), most), "gram").select("th", "item").distinct()
    return places.join(items.groupBy("th").agg(F.sort_array(F.collect_set("item")).alias("items")), "th")


def flagged(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window of a benchmark item is hit.  Null and wordless
    texts have 0 words and are clean; ids pass through (null, repeated: each row counts alone);
    items without words have no window; repeated items count by their distinct ids, null ones name none; other
    columns are ignored; empty tables give an empty result, or clean rows.
    """
    hit = persisted(scan(docs, benchmark, size, text_col, most).select("th", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("th"), F.size(split_words(F.col(text_col))).cast("long").alias("n_words"))  # case changes no count
    zero = F.lit(0).cast("long")
    return rows.join(_side(hit, most), "th", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(th, d): the digest of the text, and the whole row as one column, so that its names cannot clash."""
    return docs.select(digest(F.col(text_col)).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))


def without_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE, most: int = MOST) -> DataFrame:
    """The documents, all columns, of which no window stands in the benchmark; the others go.

    Rows are matched by a digest of the whole text, so null and repeated ids are safe.  Texts
    are shuffled only if over ``most`` different ones have a hit.
    """
    bad = persisted(scan(docs, benchmark, size, text_col, most).select("th"))
    return _packed(docs, text_col).join(_side(bad, most), "th", "left_anti").select("d.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE, most: int = MOST) -> DataFrame:
    """All documents and columns, hit words cut from their texts with the separators that follow them.

    A text of which nothing is hit is unchanged, byte for byte.  Where words were cut a line
    break stays, if another word follows.
    """
    raw, between = F.coalesce(F.col("d." + text_col), F.lit("")), BETWEEN.removesuffix("+")
    hit = persisted(scan(docs, benchmark, size, text_col, most).select("th", "hits"))
    found = _packed(docs, text_col).join(_side(hit, most // 10), "th", "left")
    whole = F.col("hits").isNull()
    parts = found.select(
        "d", "hits", F.when(~whole, split_words(raw)).alias("w"), F.when(~whole, F.split(raw, between.replace("[", "[^", 1) + "+")).alias("gaps"),
        F.when(~whole, F.array_except(F.sequence(F.lit(1), F.greatest(F.size(split_words(raw)), F.lit(1))), "hits")).alias("kept"))
    # arrays that a lambda reads are columns of their own: an expression would be made again for each element
    after_cut = lambda p, k: (p > 1) & ((k == 0) | (F.get("kept", k - 1) != p - 1))
    rest = F.transform("kept", lambda p, k: F.concat(F.when(after_cut(p, k), "\n").otherwise(""), F.get("w", p - 1), F.coalesce(F.get("gaps", p), F.lit(""))))
    joined = F.concat(F.coalesce(F.get("gaps", F.lit(0)), F.lit("")), F.array_join(rest, ""))
    cut = F.when(F.col("hits").isNull(), F.col("d." + text_col)).when(F.size("w") + F.size("gaps") + F.size("kept") >= 0, joined)
    return parts.select(*[(cut if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
