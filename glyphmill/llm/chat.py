"""Chat formatting with offset-aligned loss masks.

A conversation is ``<s>`` followed by its turns, each ``[INST]role[/INST]text</s>``.
A control string inside a role or a text gets a backslash after its first character; one that
already has backslashes there gets one more, so unescaping takes one away and loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_file, small_batches

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_BODY = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: The heads of the controls are told apart by their bodies: "<s>" and "[s>" are different texts.
_PLAIN = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (g := [x for x in m.groups() if x is not None])[0] + "\\" + g[1] + g[2], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: (g := [x for x in m.groups() if x is not None])[0] + g[1][1:] + g[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, in code points."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted[len(BEGIN) :])]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in a span: both are sorted, so each token finds its span by binary search."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans, np.int64).T
    k = np.searchsorted(starts, offsets[:, 0], "right") - 1
    return (k >= 0) & (offsets[:, 1] <= ends[np.maximum(k, 0)]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped: tokens that touch or overlap are joined before that."""
    out, start, end = [], 0, 0
    for a, b in offsets[mask]:
        if a > end:
            out.append(unescape(formatted[start:end]))
            start = a
        end = max(end, b)
    return "".join(out) + unescape(formatted[start:end])


class Encoder:
    """A byte-level BPE tokenizer that keeps the control strings whole and gives untrimmed offsets."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.add_tokens([AddedToken(c, normalized=False) for c in CONTROLS if c != "<|endoftext|>"])
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)


def format_chats(conversations: DataFrame, tokenizer_file: str, with_tokens: bool = True) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, loss_mask, and the digests read back from them.

    Rows with one conv_id (null is one of them) are a conversation, by turn, ties by role and
    text, null turns first; repeated rows are repeated turns; null roles and texts are empty.
    Every role is kept; only ``assistant`` texts are under the loss mask, an empty one without
    a token.  Other columns are ignored; an empty table gives an empty result.  A conversation
    is one string, so it has to fit a task; conversations are only grouped, never gathered further.

    n_turns, turns_sha256 and formatted_chars come from parsing ``formatted``; loss_chars and
    loss_sha256 from ``loss_mask`` over the token offsets.  ``with_tokens=False`` leaves the
    formatted text, ids and mask out of the result, not out of the work.
    """
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    extra = ", formatted string, ids array<int>, loss_mask array<boolean>" * with_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(local_file(tokenizer_file))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render(list(zip(r, t))) for r, t in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())]
                out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "ids", "loss_mask")}
                for (text, spans), coded in zip(done, encode([x for x, _ in done])):
                    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
                    mask = token_mask(offsets, spans)
                    loss, turns = masked_text(text, offsets, mask), parse(text)
                    out["n_turns"].append(len(turns))
                    out["turns_sha256"].append(_sha("".join(f"{r}\n{t}\n" for r, t in turns)))
                    out["loss_chars"].append(len(loss))
                    out["loss_sha256"].append(_sha(loss))
                    out["formatted_chars"].append(len(text))
                    if with_tokens:
                        out["ids"].append(coded.ids)
                        out["loss_mask"].append(mask.tolist())
                columns = {"conv_id": part.column("conv_id")}
                columns |= {k: pa.array(out[k], pa.string() if "sha" in k else pa.int64()) for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
                if with_tokens:
                    columns |= {"formatted": pa.array([x for x, _ in done], pa.string()), "ids": pa.array(out["ids"], pa.list_(pa.int32())), "loss_mask": pa.array(out["loss_mask"], pa.list_(pa.bool_()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return grouped.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long{extra}")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
