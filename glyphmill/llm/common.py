"""What the operators of this subpackage share: words, hashes, byte-balanced batches, checkpoints."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words: words are runs of ASCII digits, letters and anything outside ASCII, A-Z lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one step of an Arrow function holds.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_LOWER_LUT = np.arange(256, dtype=np.uint8)
_LOWER_LUT[65:91] += 32
_WORD_LUT = np.zeros(256, dtype=bool)
_WORD_LUT[48:58] = _WORD_LUT[97:123] = _WORD_LUT[128:] = True


def split_words(text: Column) -> Column:
    """array<string> of the words of a text as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def words(text: Column) -> Column:
    """array<string> of the lower-cased words of a text; null has none."""
    return split_words(F.translate(text, UPPER, LOWER))


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut the Arrow batches that it sends to Python by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def local_file(name: str) -> str:
    """A path as it is; a bare name is that of a public tokenizer's file, found on the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def persisted(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session.

    The folder is the one named by ``spark.checkpoint.dir``; only where that is
    unset and the session runs on one machine is a temporary folder taken.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmill-"))
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled training ids, drawn evenly by a hash of the id.

    ``most`` bounds the ids that are broadcast, so that only labelled texts are shuffled; of the rows of one
    id the greatest text is taken.  ``most_bytes`` ends the sample, in the order of the hash, where the texts
    reach so many bytes (the first is always taken); the sizes that it needs, one for each id, come to the driver.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    if most_bytes is None:
        return rows
    rows = persisted(rows.withColumn("__h", F.xxhash64("doc_id")))
    sizes = rows.select("__h", F.octet_length("text").alias("n")).orderBy("__h", "n").toArrow()
    reached = np.cumsum(np.asarray(sizes.column("n"), np.int64))
    cut = max(1, int(np.searchsorted(reached, most_bytes, "right")))
    if cut >= len(reached):
        return rows.drop("__h")
    return rows.where(F.col("__h") <= sizes.column("__h")[cut - 1].as_py()).drop("__h")


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Yield parts of a batch of about ``most`` bytes of text each; a longer text stands alone."""
    _, off = string_parts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes, vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, wrapped to 64 bits."""
    if len(_powers[0]) < n + 1:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                row = np.full(n + 1, base, np.uint64)
                row[0] = 1
                _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


class Words:
    """The words of a slice of texts: document index, start, end, and hashes of any byte range."""

    def __init__(self, column: pa.Array):
        data, self.offsets = string_parts(column)
        self.n_docs, low = len(self.offsets) - 1, _LOWER_LUT[data]
        self._low = low
        is_word = _WORD_LUT[low]
        before, after = np.zeros_like(is_word), np.zeros_like(is_word)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        forward, self._back = _power(len(data))
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each byte range; equal (lower-cased) bytes have equal hashes."""
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def pieces(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of the pieces of ``size`` letters that words are cut into; a word's last one may be shorter."""
        letter = self._letters()
        word = np.searchsorted(self.start, letter, "right") - 1
        begins = (np.arange(len(letter)) - np.searchsorted(letter, self.start)[word]) % size == 0
        at, word = letter[begins], word[begins]
        end = self.end[word]
        inner = word[1:] == word[:-1]
        end[:-1][inner] = at[1:][inner]
        return at, end, word

    def _letters(self) -> np.ndarray:
        """Where the letters of words begin: bytes of words that do not continue a UTF-8 sequence."""
        return np.flatnonzero(_WORD_LUT[self._low] & ((self._low & 0xC0) != 0x80))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every distinct word n-gram, sorted by both; a text of fewer words is one n-gram."""
        word, doc = self.hashes(self.start, self.end), self.doc
        n = np.bincount(doc, minlength=self.n_docs) if len(doc) else np.zeros(self.n_docs, np.int64)
        firsts, seeds = np.concatenate([[0], np.cumsum(n)[:-1]]), np.uint64(0x2545F4914F6CDD1D)
        parts_d, parts_h = [], []
        with np.errstate(over="ignore"):
            if len(word) >= size:
                m = len(word) - size + 1
                h = np.zeros(m, np.uint64)
                for j in range(size):
                    h = h * seeds + word[j : j + m]
                whole = doc[:m] == doc[size - 1 :]
                parts_d.append(doc[:m][whole])
                parts_h.append(mix(h[whole]))
            for d in np.flatnonzero((n > 0) & (n < size)):
                h = np.uint64(n[d])
                for w in word[firsts[d] : firsts[d] + n[d]]:
                    h = h * seeds + w
                parts_d.append(np.array([d]))
                parts_h.append(mix(np.array([h], np.uint64)))
        if not parts_d:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        d, h = np.concatenate(parts_d), np.concatenate(parts_h)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return d[keep], h[keep]
