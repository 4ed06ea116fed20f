"""Scalar text functions as column expressions (Unicode normal forms excepted, which Spark lacks)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kana that count as pure hiragana and katakana.
HIRAGANA = (
    "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんぁぃぅぇぉゃゅょゎっゔー"
    "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽ"
)
KATAKANA = (
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンァィゥェォャュョヮッヴー"
    "ガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポ"
)
#: Hiragana U+3041 to U+3093 and what lies 0x60 above them.
_HIRA_RUN = "".join(map(chr, range(0x3041, 0x3094)))
_KATA_RUN = "".join(chr(ord(c) + 0x60) for c in _HIRA_RUN)
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def hira_to_kata(c: Column) -> Column:
    """Hiragana to katakana; U+3094 and the long mark stay."""
    return F.translate(c, _HIRA_RUN, _KATA_RUN)


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return run


def _unless_ascii(c: Column, form: str) -> Column:
    # ASCII is its own normal form, so most rows of most tables never meet Python
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_normal(form)(c))


def nfc(c: Column) -> Column:
    return _unless_ascii(c, "NFC")


def nfkc_reading(c: Column) -> Column:
    """NFKC, then the ASCII tilde becomes the wave dash."""
    return F.replace(_unless_ascii(c, "NFKC"), F.lit("~"), F.lit("〜"))


def _only(c: Column, chars: str, normalised: bool) -> Column:
    return (c if normalised else nfc(c)).rlike(f"^[{chars}]+$")


def is_hiragana(c: Column, normalised: bool = False) -> Column:
    """Not empty and all hiragana or long marks, after NFC unless the column is normalised."""
    return _only(c, HIRAGANA, normalised)


def is_katakana(c: Column, normalised: bool = False) -> Column:
    return _only(c, KATAKANA, normalised)


def is_kana(c: Column, normalised: bool = False, mixed: bool = False) -> Column:
    """Hiragana only or katakana only; ``mixed`` allows both in one text."""
    return _only(c, HIRAGANA + KATAKANA, normalised) if mixed else is_hiragana(c, normalised) | is_katakana(c, normalised)


def surface_kind(key: Column, surface: Column, normalised: bool = False) -> Column:
    """reading, katakana or text: how a surface is kept; the first two are made from the key again."""
    return F.when((key == surface) | is_hiragana(surface, normalised), "reading").when(is_katakana(surface, normalised), "katakana").otherwise("text")


def decoded_surface(kind: Column, key: Column, surface: Column) -> Column:
    """The surface that conversion shows: a kana surface is replaced by its reading, or that in katakana."""
    return F.when(kind == "reading", key).when(kind == "katakana", hira_to_kata(key)).otherwise(surface)


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_order(c: Column) -> Column:
    """A binary column that sorts by UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def normalize_reading(c: Column) -> Column:
    return F.translate(c, "ゕゖ", "かけ")


def trim_blank(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    blank = r"[\s\x1C-\x1F\p{Z}]"
    # a trailing run is tried from its first blank alone, so that long runs inside a text cost no more than their length
    return F.regexp_replace(c, f"^{blank}+|(?<!{blank}){blank}+$", "")


def is_vocalization(c: Column) -> Column:
    """Two or more letters: a vowel, then only long marks and the same vowel, small or not."""
    return c.rlike("^(?:[あぁ][あぁー]+|[いぃ][いぃー]+|[うぅ][うぅー]+|[えぇ][えぇー]+|[おぉ][おぉー]+)$")


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def remove_trailing_number(c: Column) -> Column:
    return F.regexp_replace(c, "^([^0-9]+)[0-9]+$", "$1")


def description_readings(c: Column) -> Column:
    """Parts of a description between brackets, slashes and middle dots; an empty one has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(nfkc_reading(c), r"[()/・]+", -1), remove_trailing_number))


def split_keeping_empty(c: Column, delimiter: str) -> Column:
    return F.split(c, f"\\Q{delimiter}\\E", -1)


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two binary columns share from the start; 0 if either is null."""
    ha, hb = F.hex(a), F.hex(b)
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(ha, i * 2 - 1, F.lit(2)) != F.substring(hb, i * 2 - 1, F.lit(2)))
    return F.coalesce(F.when(a.isNull() | b.isNull() | (n == 0), 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n)), F.lit(0)).cast("int")


# Kinds of rule features and their codes.
KINDS = {"word": 1, "pos": 2, "any": 3}


def signature(kinds: Column) -> Column:
    """array<int> of feature kinds to one int: the order in three bits, then two bits for each slot."""
    slots = F.transform(kinds, lambda k, i: k.cast("int") * F.pow(F.lit(2.0), 3 + i * 2).cast("int"))
    return F.aggregate(slots, F.size(kinds), lambda a, x: a.bitwiseOR(x))


def signature_order(c: Column) -> Column:
    return c.bitwiseAND(F.lit(7))


def signature_kind(c: Column, slot: int) -> Column:
    return F.shiftrightunsigned(c, 3 + 2 * slot).bitwiseAND(F.lit(3))


def canonical(features: Column) -> Column:
    """Readable key of array<struct<kind, value>>: ``W:x|P:y|*``."""
    part = lambda f: F.when(f["kind"] == KINDS["word"], F.concat(F.lit("W:"), f["value"])).when(f["kind"] == KINDS["pos"], F.concat(F.lit("P:"), f["value"])).otherwise("*")
    return F.array_join(F.transform(features, part), "|")


@F.pandas_udf(T.LongType())
def hash64(s: pd.Series) -> pd.Series:
    """FNV-1a over the bytes with a 64-bit finaliser, as a signed long (binary column); all rows of a batch at once, byte by byte."""
    # Offset, prime and the two mixing factors.
    offset, prime, mixes = -3750763034362895579, 1099511628211, (-49064778989728563, -4265267296055464877)
    some = s.notna().to_numpy()
    parts = [bytes(x) for x in s[some]]
    size = np.array([len(x) for x in parts], np.int64)
    order = np.argsort(-size, kind="stable")  # longest first, so that the rows that have a byte at a place stand in front
    data, at = np.frombuffer(b"".join(parts[i] for i in order), np.uint8), np.cumsum(size[order]) - size[order]
    h = np.full(len(parts), offset, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for place in range(int(size.max()) if len(size) else 0):
            n = int(np.searchsorted(-size[order], -place, "left"))  # rows longer than the place
            h[:n] = (h[:n] ^ data[at[:n] + place]) * np.uint64(prime)
        for m in mixes:
            h = (h ^ h >> np.uint64(33)) * np.array(m, np.int64).view(np.uint64)
        h ^= h >> np.uint64(33)
    values = np.empty(len(parts), np.int64)
    values[order] = h.view(np.int64)
    out = pd.Series([None] * len(s), dtype="Int64", index=s.index)
    out[some] = values
    return out
