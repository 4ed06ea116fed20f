"""Personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, small_batches

#: Kinds in the order in which spans of one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Cues after which an account number may follow.
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")
#: Cues after which a sign of assignment and a secret may follow, and heads of keys that need none.
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "bearer")
KEY_HEADS = ("akia", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "-----begin ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'\x00-\x1f]+")
_DIGITS = re.compile(r"[0-9]+")
_ASSIGNED = re.compile(r"[A-Za-z_-]{0,16}[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*[\"']?([^\s\"'<>,;]{8,})|[ \t]+(?=[A-Za-z0-9._~+/-]*[0-9])([A-Za-z0-9._~+/-]{16,}=*)")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[posu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]{0,8192}-----END [A-Z ]{0,24}PRIVATE KEY-----)?")
_AFTER_CUE = re.compile(r"[ \t]*(?:(?:number|no\.?|nr\.?)[ \t]*)?(?:[:#=][ \t]*)?([A-Za-z]{0,2}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Mod-97 check of an international account number."""
    t = text.replace(" ", "").replace("-", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def automaton():
    """Anchors: at-signs, plus signs, schemes, cues and heads of keys."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, names in (("@", "@"), ("+", "+"), ("s", SCHEMES), ("c", CUES), ("=", SECRET_CUES), ("k", KEY_HEADS)):
        for x in names:
            a.add_word(x, (kind, len(x)))
    a.make_automaton()
    return a


class Finder:
    """Spans (start, kind number, end) of one text after another, in code points, end exclusive."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        after = [0] * len(KINDS)  # where the last match of each kind ended, dropped ones too
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for run in _DIGITS.finditer(text):  # numbers begin where a run of digits does
            at = run.start()
            if at >= after[1] and (m := _IP.match(text, at)):
                after[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((at, 1, m.end()))
            if at >= after[2] and (m := _CARD.match(text, at)):
                after[2] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        for last, (anchor, size) in self.anchors.iter(low):
            at = last - size + 1
            if anchor == "@":
                if (m := _DOMAIN.match(text, at + 1)) and at > after[0]:
                    start = at
                    while start > after[0] and text[start - 1] in _LOCAL:
                        start -= 1
                    if start < at:
                        after[0] = m.end()
                        found.append((start, 0, m.end()))
            elif anchor == "+":
                if at >= after[3] and (m := _PHONE.match(text, at)):
                    after[3] = m.end()
                    if 10 <= sum(map(_digit, m[0])) <= 15:
                        found.append((at, 3, m.end()))
            elif anchor == "s":
                if at >= after[4] and (m := _URL.match(text, last + 1)):
                    end = m.start() + len(m[0].rstrip(".,;:!?)]}"))
                    if end > m.start():
                        after[4] = end
                        found.append((at, 4, end))
            elif anchor == "=":
                if last + 1 >= after[6] and (m := _ASSIGNED.match(text, last + 1)):
                    k = 1 if m[1] else 2
                    if self._random(m[k]):
                        after[6] = m.end()
                        found.append((m.start(k), 6, m.end(k)))
            elif anchor == "k":
                if at >= after[6] and (not at or not text[at - 1].isalnum()) and (m := _KEY.match(text, at)):
                    after[6] = m.end()
                    found.append((at, 6, m.end()))
            elif last + 1 >= after[5] and (not at or not text[at - 1].isalnum()) and (m := _AFTER_CUE.match(text, last + 1)):
                after[5] = m.end()
                digits = sum(map(_digit, m[1]))
                if (iban(m[1]) if m[1][:2].isalpha() and digits > 12 else 6 <= digits <= 18):
                    found.append((m.start(1), 5, m.end(1)))
        return sorted(found)

    @staticmethod
    def _random(value: str) -> bool:
        """Whether a value after a cue looks made by a machine or a cautious person: two kinds of letters, digits and signs at least."""
        return sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(map(_digit, value)), any(not c.isalnum() for c in value))) >= 2


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account, n_secret, n_spans.

    Base spans are the leftmost non-overlapping matches of each base kind; those that fail
    validation are dropped without another try.  The added kinds are links after a scheme,
    account numbers after a cue, and secrets: values assigned after a cue, and keys with a known head.  Null counts as empty; an empty text has the digest of ''.
    Ids pass through (null, repeated); other columns are ignored; an empty table gives an
    empty result.  Work is linear in a text: every anchor is looked at once, and matches of a
    kind do not overlap.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    counted = {"n_email": 0, "n_ip": 1, "n_card": 2, "n_phone": 3, "n_url": 4, "n_account": 5, "n_secret": 6}
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account", "n_secret", "n_spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            for part in byte_slices(batch):
                rows = [finder.spans(x or "") for x in part.column("text").to_pylist()]
                out = {"doc_id": part.column("doc_id")} | {c: pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for c, k in counted.items()}
                out["base_sha256"] = pa.array([hashlib.sha256(named([s for s in r if s[1] < 4]).encode()).hexdigest() for r in rows], pa.string())
                out["n_spans"] = pa.array([len(r) for r in rows], pa.int64())
                out["spans"] = pa.array([named(r) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long, n_secret long, n_spans long")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every found span replaced by its kind in angle brackets; overlapping ones go as one, named by the first and longest."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in byte_slices(batch, text_col):
                texts = []
                for x in part.column(at).to_pylist():
                    spans, out, end = sorted(finder.spans(x or ""), key=lambda s: (s[0], -s[2])), [], 0
                    for s, k, e in spans:
                        if s >= end:
                            out += [x[end:s], f"<{KINDS[k]}>"]
                        end = max(end, e)
                    texts.append(x if x is None else "".join(out) + x[end:])
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)
