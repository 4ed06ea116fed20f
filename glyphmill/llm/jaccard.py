"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, mix, persisted, small_batches
from .components import components

SHINGLE, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Sets, and n-grams, that one side of a verification holds; larger buckets are verified block by block.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1_000_000
#: Keys of rows up to which they are broadcast (about 60 bytes each); more are joined by a shuffle.
MOST = 100_000


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance candidates, by which a pair at the threshold shares a band with the probability ``recall``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def signatures(doc: np.ndarray, gram: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, 128-bit digests of the sets, band hashes) of the documents' n-gram sets."""
    size = np.bincount(doc, minlength=n_docs)
    digest, keys = np.zeros((n_docs, 2), np.uint64), np.zeros((n_docs, bands), np.uint64)
    has = np.flatnonzero(size)
    if not len(has):
        return size, digest, keys
    first = np.concatenate([[0], np.cumsum(size[has])[:-1]])
    rng = np.random.default_rng(20240229)
    factor = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i, seed in enumerate((np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127))):
            digest[has, i] = np.add.reduceat(mix(gram ^ seed), first)
        for b in range(bands):
            h = np.full(len(has), b + 1, np.uint64)
            for r in range(rows):
                low = np.minimum.reduceat((gram * factor[b * rows + r]) >> np.uint64(20), first)
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + low)
            keys[has, b] = h
    return size, digest, keys


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets: rare n-grams pair by pair, frequent ones by matrix products."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    count = count[col]
    inter = np.zeros(m * m, np.float64)
    for d in range(2, 13):
        r = row[count == d].reshape(-1, d)
        for p in range(d):
            for q in range(p + 1, d):
                inter += np.bincount(r[:, p] * m + r[:, q], minlength=m * m)
    inter = inter.reshape(m, m)
    inter += inter.T
    frequent = count > 12
    row, (_, col) = row[frequent], np.unique(col[frequent], return_inverse=True)
    for c in range(0, col.max() + 1 if len(col) else 0, 4096):
        own = (col >= c) & (col < c + 4096)
        dense = np.zeros((m, 4096), np.float32)
        dense[row[own], col[own] - c] = 1
        inter += dense @ dense.T
    return inter


def verify(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray | None, band: int, threshold: float) -> np.ndarray:
    """Which pairs of a bucket or block are links that no earlier band has found; symmetric.

    ``side`` parts the members of two blocks, of which only pairs across count; None for members of one.
    """
    m = len(sets)
    new = ~np.eye(m, dtype=bool)
    if side is not None:
        new &= side[:, None] != side[None, :]
    for k in range(band):
        new &= keys[:, k][:, None] != keys[:, k][None, :]
    open_rows = np.flatnonzero(new.any(1))
    out = np.zeros((m, m), bool)
    if len(open_rows):
        size = np.array([len(sets[i]) for i in open_rows], np.float64)
        inter = overlaps([sets[i] for i in open_rows])
        out[np.ix_(open_rows, open_rows)] = (inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9) & new[np.ix_(open_rows, open_rows)]
    return out


def _spanning(link: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    root = np.arange(len(link))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(link)).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linked(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", bands: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the digests of their texts and sets, different sets, linked sets with counts and a spanning link), by steps 1 to 3 of ``near_duplicates``."""
    spark = docs.sparkSession
    small_batches(spark)
    n_bands, n_rows = bands or plan_bands(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("th"), text.alias("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))  # a null id is one of its own
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                size, digest, keys = signatures(*Words(part.column("text")).shingles(shingle), part.num_rows, n_bands, n_rows)
                flat = digest.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("th"), pa.array([flat[16 * i : 16 * i + 16] if n else None for i, n in enumerate(size)], pa.binary()), pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * n_bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))], ["doc_id", "th", "digest", "size", "keys"])

    signed = persisted(rows.mapInArrow(sign, f"doc_id {kind}, th binary, digest binary, size long, keys array<long>"))
    sets = persisted(
        signed.where("size > 0").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    entries = sets.select("digest", "size", F.posexplode("keys").alias("band", "key"))
    mark = F.xxhash64("digest")
    buckets = (
        entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("x2"))
        .where("m > 1").groupBy("m", "grams", "x", "x2").agg(F.min(F.struct("band", "key")).alias("b"))
        .select("b.band", "b.key", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("digest", F.lit(3)), F.col("blocks")).cast("int")
    goals = (
        entries.drop("size").join(buckets, ["band", "key"]).withColumn("own", own)
        .withColumn("goal", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct("band", "key", F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"), "own")))
        .groupBy("digest").agg(F.flatten(F.collect_list("goal")).alias("goals"))
    )
    wanted = persisted(goals.join(sets.select("digest", "rep", "copies", "keys"), "digest").select(
        F.col("rep.th").alias("th"), F.coalesce(F.col("rep.doc_id").cast("string"), F.lit("\x00")).alias("name"), "digest", "copies", "keys", "goals"))
    keyed, asked = rows.select("th", named.alias("name"), "text"), wanted.select("th", "name")
    if wanted.count() <= MOST:
        keyed = keyed.join(F.broadcast(asked), ["th", "name"], "left_semi")
    # repeated rows of a representative become one, first within each map task, before they meet its goals
    once = keyed.groupBy("th", "name").agg(F.first("text").alias("text"))
    texts = once.join(wanted, ["th", "name"]).select("digest", "copies", "keys", "goals", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                doc, gram = Words(part.column("text")).shingles(shingle)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("digest", "copies", "keys", "goals")), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gram.view(np.int64)))], ["digest", "copies", "keys", "goals", "grams"])

    goal_type = "array<struct<band:int,key:bigint,i:int,j:int,own:int>>"
    sent = (
        texts.withColumn("goals", F.col("goals").cast(goal_type)).mapInArrow(grams, f"digest binary, copies long, keys array<long>, goals {goal_type}, grams array<long>")
        .select("digest", "copies", "keys", "grams", F.explode("goals").alias("g")).select("g.*", "digest", "copies", "keys", "grams")
        .repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: dict[bytes, tuple], band: int, whole: bool):
            members = list(group.values())
            if len(members) < 2:
                return
            link = verify([g[3] for g in members], np.array([g[2] for g in members]), None if whole else np.array([g[4] for g in members]), band, threshold)
            found = np.flatnonzero(link.any(1))
            if not len(found):
                return
            copies = np.array([g[1] for g in members], np.int64)
            n_docs, n_sets, root = link @ copies, link.sum(1), _spanning(link)
            for i in found:
                yield members[i][0], int(n_docs[i]), int(n_sets[i]), members[root[i]][0]

        def groups():
            at, group = None, {}
            for batch in batches:
                heads = list(zip(*(batch.column(c).to_pylist() for c in ("band", "key", "i", "j"))))
                lists = {c: (np.asarray(batch.column(c).flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(batch.column(c).value_lengths()))])) for c in ("keys", "grams")}
                plain = [batch.column(c).to_pylist() for c in ("digest", "copies", "own")]
                cut = lambda c, r: lists[c][0][lists[c][1][r] : lists[c][1][r + 1]].copy()
                for r, head in enumerate(heads):
                    if head != at:
                        if at:
                            yield at, group
                        at, group = head, {}
                    if plain[0][r] not in group:
                        group[plain[0][r]] = (plain[0][r], plain[1][r], cut("keys", r), cut("grams", r), plain[2][r] == head[2])
            if at:
                yield at, group

        out: list[tuple] = []
        for (band, _, i, j), group in groups():
            out += links(group, band, i == j)
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return signed, sets, persisted(sent.mapInArrow(decide, "digest binary, n_docs long, n_sets long, root binary"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", bands: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, n_linked_sets.

    Two documents are linked if the sets of their word 5-grams have Jaccard similarity 0.8 or
    more; a text of one to four words is one n-gram; texts without words (null, empty) are
    linked with nothing.  class_id: the least id of the documents that links connect;
    n_links: the other documents that a document is linked with, copies with the same set
    (n_copies) among them; n_linked_sets: the different sets among them.  Null ids are in
    classes but never name one; repeated rows count as often as they stand; other columns are
    ignored; an empty table gives an empty result.

    1. One pass gives each text a digest of its set and band hashes; equal sets become one.
    2. Band hashes are shuffled; buckets of one set go, of buckets with the same members one stays.
    3. Only sets in a bucket are made again and sent there once for each bucket.  A bucket
       over the block size is verified in pairs of blocks.  A pair is decided in the first
       band that it shares.  Counts and a spanning link for each set leave the task, never pairs.
    4. Stars over the spanning links give the classes.

    Candidates are found with the probability ``recall`` at the threshold, more above it; what is found is exact.
    """
    signed, sets, found = _linked(docs, threshold, shingle, recall, id_col, text_col, bands)
    counts = found.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_sets").alias("n_sets"))
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "digest")
    named = roots.join(sets.select("digest", "least"), "digest")
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = roots.join(names, "root").join(counts, "digest").drop("root")
    classes = sets.select("digest", "least", "copies").join(linked, "digest", "left").select(
        "digest", F.coalesce("class_id", "least").alias("class_id"), "copies", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"))
    # of the rows of one set, however many, only digests meet the class; Spark parts a hot one on that side
    return signed.select("doc_id", "digest").join(classes, "digest", "left").select(
        "doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"), F.coalesce("n_sets", F.lit(0)).alias("n_linked_sets"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["digest", "n_docs", "n_sets", "root"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, one row of each class; rows without words all stay.

    The row with the class's least id stays, null ids last; of equal ids the one whose text has the least digest.
    Rows are matched by id and a digest of the text, so null and repeated ids are safe; of
    repeated rows of that document any one stays.
    """
    signed, _, found = _linked(docs, id_col=id_col, text_col=text_col, **options)
    keys = signed.where("size > 0").groupBy("digest", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("first")
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "digest")
    sets = keys.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_keys")).join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = sets.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n_keys").alias("n_keys")).where("n_keys > 1 or stays.n > 1")
    plan = persisted(sets.join(classes.select("root", "stays"), "root").select("digest", F.col("stays.doc_id").alias("id"), F.col("stays.th").alias("th"), F.col("stays.n").alias("n")))
    gone = keys.drop("n").join(plan.select("digest", F.col("id").alias("stay"), F.col("th").alias("stay_th")), "digest")
    gone = persisted(gone.where(~(F.col("doc_id").eqNullSafe(F.col("stay")) & (F.col("th") == F.col("stay_th")))).select(F.col("doc_id").alias("id"), "th"))
    side = lambda df: F.broadcast(df) if df.count() <= MOST else df
    # the row is one column, so that its names cannot clash
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    out, away = rows.alias("a"), side(gone).alias("b")
    left = out.join(away, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left_anti")
    repeated = persisted(plan.where("n > 1").select("id", "th").distinct())
    if not repeated.isEmpty():  # only their texts are shuffled
        again = side(repeated).alias("b")
        same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
        left = left.alias("a")
        one = left.join(again, same, "left_semi").groupBy("id", "th").agg(F.first("d").alias("d"))
        left = left.join(again, same, "left_anti").select("d").unionByName(one.select("d"))
    return left.select("d.*")
