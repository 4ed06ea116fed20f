"""Token counts with a subword tokenizer, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, local_file, small_batches

#: Letters of units that a worker remembers, and of the longest unit among them; a full memory is emptied, which changes no count.
MEMO, LONGEST = 16 << 20, 64
_UNIT = re.compile(" +[^ ]*")
_SPACE = "▁"


class PieceCounter:
    """Exact token counts of a sentencepiece BPE model by units between safe boundaries.

    The model writes a blank as U+2581 and no piece holds one after another character
    (checked here), so no merge crosses the place before a run of blanks: a text's count
    is the sum over its units, and each distinct unit is encoded once for a batch.  A
    model that breaks the rule, or that changes blanks, encodes whole texts instead.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        crossing = any(a != _SPACE and b == _SPACE for p in pieces for a, b in zip(p, p[1:]))
        probe = [" a", "a  b", "a ", "Aﬁ　b"]
        self.by_unit = not crossing and ["".join(x).replace(_SPACE, " ") for x in self.model.encode(probe, out_type=str)] == [" " + x for x in probe]
        self.memo: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text, each without its first blank, which the encoder adds itself."""
        if not text:
            return []
        text = text.replace(_SPACE, " ")
        parts = text.split(" ")
        if "" in parts:
            parts = [u[1:] for u in _UNIT.findall(" " + text)]
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if self.held > MEMO:
            self.memo, self.held = {}, 0
        memo, parts = self.memo, [self.units(x) for x in texts]
        new, long = list({u for p in parts for u in p}.difference(memo)), {}
        for i in range(0, len(new), 4096):
            block = new[i : i + 4096]
            for u, e in zip(block, self.model.encode(block, num_threads=1)):
                # an empty unit stands for one blank, which the encoder would not add to nothing
                n = len(e) if u else 1
                if len(u) > LONGEST:
                    long[u] = n
                else:
                    memo[u] = n
                    self.held += len(u) + 64
        if long:
            return [sum(long[u] if len(u) > LONGEST else memo[u] for u in p) for p in parts]
        return [sum(map(memo.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts, no begin, end or added special tokens; null counts as empty, an empty text
    has 0 tokens.  Only lengths come back from Python.  Batches are cut by bytes, and long
    texts meet the encoder in units.  Ids pass through untouched (null, repeated); other
    columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(local_file(model_file))
        for batch in batches:
            for part in byte_slices(batch):
                n = counter.counts([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(np.array(n, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
