"""Quality of reading dictionaries of loanwords: flags, status, score, runtime rows, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .dictionary import cheapest, ranked
from .dictionary import summary as dictionary_summary
from .validate import ValidationError, repeated, require_none

# The words, pairs and patterns that decide a row's flags and status.
NUMERIC_WORDS = (
    "zero", "nought", "nil", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty",
    "ninety", "hundred", "thousand", "million", "billion", "trillion", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
    "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth",
    "twentieth",
)
FUNCTION_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "to", "of", "in", "on", "at", "by", "for", "with", "from", "as", "is", "am", "are",
    "be", "was", "were", "been", "being", "do", "does", "did", "it", "this", "that", "these", "those", "here", "there", "who", "whom", "whose",
    "which", "what", "when", "where", "why", "how", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "we", "us",
    "our", "ours", "they", "them", "their", "theirs", "some", "any", "no", "not", "nor",
)
INTERJECTIONS = (
    "aah", "aaah", "ah", "alas", "argh", "blech", "bleh", "eek", "eew", "er", "erm", "gah", "hmm", "hmmm", "huh", "ick", "meh", "ooh", "ouch", "ow",
    "phew", "phooey", "pish", "pshaw", "sigh", "shh", "shush", "ugh", "ulp", "um", "ungh", "whoa", "wow", "yikes", "yahoo", "yay", "oops",
    "oops-a-daisy", "ha ha", "ha ha ha", "haha", "hahaha", "he he", "hehe", "hee hee", "hee hee hee", "hee-hee", "tee hee", "tee-hee", "hi hi hi",
    "uh huh", "uh-huh", "mm-hmm", "yeah yeah", "sure sure", "no no", "no-no",
)
SHORT_RESPONSES = (
    "gotcha", "indeed", "right", "yes", "okay", "well", "sure", "understood", "oh", "yeah",
)
ALLOWED_COMPOUNDS = (("あいすくりーむ", "ice cream"), ("あーとぎゃらりー", "art gallery"), ("きーほるだー", "key holder"))
HYPHENS = "-‐‑‒–—"
GLOSS = r"""(?i)(?:^\s*(?:used\s+(?:to|after|with|for|as)|indicates?\b|counter\s+(?:for|used)\b|softens?\b|regardless\s+of\b|whether\b|no\s+matter\b|followed\s+by\b|preceded\s+by\b|person\s+(?:who|with|of)\b|people\s+(?:who|with)\b|someone\s+who\b|something\s+(?:that|which)\b|thing\s+(?:or|that|which)\b|device\s+used\b|method\s+(?:of|used)\b|sound\s+(?:of|used)\b|one's\b|to\s+be\b|in\s+(?:a|the)\b|with\s+(?:a|the)\b|for\s+(?:a|the)\b|by\s+(?:a|the)\b|any\b|(?:type|kind|form|group|member|species|variety|family|genus)\s+of\b)|\b(?:used\s+(?:to|for|as|with)|person\s+(?:who|with|of)|people\s+(?:who|with))\b)"""
FRAGMENT = r"""(?i)\A\s*(?:(?:the|a|an)\s+(?:act|action|process|state|condition|quality|property|characteristic|kind|type|form|way|place|person|people|someone|something|thing|device|method|sound|group|member|species|variety|family|genus|mark|term|word|name|symbol|letter|part|piece|amount|degree|period|time|area|region|side|edge|surface|material|substance|food|dish|drink|plant|animal|bird|fish|insect|tree|flower|color|colour|language|country|city|river|mountain)|(?:person|people|someone|something|thing|device|method|sound|member|species|variety|family|genus)\s+|(?:usually|generally|typically|specifically|especially|primarily|normally|often)\s+)|\b(?:the\s+act\s+of|the\s+state\s+of|the\s+process\s+of|the\s+quality\s+of|one's|someone's|something's)\b|\A(?:using|used)\s+.+\b(?:to|for|as|with)\b|\A(?:[a-z]+\s+){0,2}(?:that|which|who|where|while|when)\s+"""
FLAGS = (
    "reading-normalized", "surface-normalized", "special-reading", "vocalization-reading", "single-character-reading", "punctuation-only",
    "exclamatory-surface", "single-letter-surface", "numeric-surface", "function-word-surface", "interjection-surface", "bound-morpheme",
    "incomplete-placeholder", "explanatory-gloss", "long-definition", "definition-fragment", "parenthetical",
)
REVIEW_FLAGS = ("explanatory-gloss", "long-definition", "definition-fragment")
PRIMARY, REVIEW, EXCLUDED = "PRIMARY", "REVIEW", "EXCLUDED"


def _conditions(yomi: Column, tango: Column, reading: Column, surface: Column) -> dict[str, Column]:
    """The condition of each flag, in order."""
    low = F.lower(surface)  # of a surface without blanks around it
    size = X.utf16_length(surface)
    spaces = F.length(surface) - F.length(F.replace(surface, F.lit(" "), F.lit("")))
    vocal = X.is_vocalization(reading)
    numeric = low.isin(*NUMERIC_WORDS) | low.rlike("^[0-9]+(?:st|nd|rd|th)?$") | (low.rlike(r"^[\p{Nd}^+\-*/=.]+$") & low.rlike(r"\p{Nd}"))
    interjection = low.isin(*INTERJECTIONS) | (low.isin(*SHORT_RESPONSES) & ((X.utf16_length(reading) <= 2) | vocal))
    return dict(zip(FLAGS, (
        reading != yomi,
        surface != tango,
        yomi.rlike("[ゝゞ]") | (yomi == "ー"),
        vocal,
        X.utf16_length(reading) == 1,
        surface.rlike(r"^[^\p{L}\p{Nd}\s\x1C-\x1F\p{Z}]+$"),
        surface.rlike("[!?！？]"),
        surface.rlike("^[A-Za-z]$"),
        numeric,
        (surface == low) & surface.isin(*FUNCTION_WORDS),
        interjection,
        surface.rlike(f"^[{HYPHENS}]|[{HYPHENS}]$"),
        surface.contains("...") | surface.contains("…"),
        surface.rlike(GLOSS),
        (spaces + 1 >= 8) | (size >= 64) | ((size >= 45) & surface.rlike(r"^\p{Ll}")),
        surface.rlike(FRAGMENT),
        tango.rlike("[()]"),
    )))


def assessed(rows: DataFrame) -> DataFrame:
    """Rows (yomi, tango, cost, ...) with norm_reading, norm_surface, status, score, flags and runtime_cost."""
    base = rows.withColumn("norm_reading", X.normalize_reading(F.col("yomi"))).withColumn("norm_surface", X.trim_blank(F.col("tango")))
    c = _conditions(*(F.col(n) for n in ("yomi", "tango", "norm_reading", "norm_surface")))
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in c.items()]))
    # conditions are computed once, as the flag list, and everything else is read off it
    out = base.withColumn("flags", flags)
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    surface, reading = F.col("norm_surface"), F.col("norm_reading")
    hard = has(*FLAGS[2:13]) | surface.rlike("[()]")
    phrase = surface.rlike(rf"[\s\x1C-\x1F\p{{Z}}{HYPHENS}]")
    allowed = reduce(Column.__or__, [(reading == r) & (surface == s) for r, s in ALLOWED_COMPOUNDS])
    status = F.when(hard, EXCLUDED).when((phrase & ~allowed) | has(*REVIEW_FLAGS), REVIEW).otherwise(PRIMARY)
    n = F.size(F.array_intersect("flags", F.array(*map(F.lit, REVIEW_FLAGS))))
    return (
        out.withColumn("status", status)
        .withColumn("score", F.when(F.col("status") == PRIMARY, 100).when(F.col("status") == REVIEW, F.greatest(F.lit(40), 100 - n * 20)).otherwise(0))
        .withColumn("runtime_cost", F.when(F.col("status") == PRIMARY, F.col("cost").cast("int")))
    )


def runtime_rows(assessment: DataFrame) -> DataFrame:
    """The primary rows, normalised; of those alike but for case the cheapest, ties to the first by ord."""
    primary = assessment.where(F.col("status") == PRIMARY).withColumn("yomi", F.col("norm_reading")).withColumn("tango", F.col("norm_surface")).withColumn("__low", F.lower("norm_surface"))
    return cheapest(primary, ["yomi", "__low"], "cost", ["ord"]).drop("__low")


def flag_counts(assessment: DataFrame) -> DataFrame:
    """(flag, n) of the flags that occur."""
    return assessment.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def summary(assessment: DataFrame) -> DataFrame:
    """One row of counts by status, of runtime rows, and of readings; one pass, as each different primary pair is a runtime row."""
    primary = lambda c: F.when(F.col("status") == PRIMARY, c)
    few = assessment.select("yomi", "status", primary(F.col("norm_reading")).alias("reading"), primary(F.lower("norm_surface")).alias("surface"))
    return few.agg(
        F.count(F.lit(1)).alias("raw_entries"), *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_entries") for s in (PRIMARY, REVIEW, EXCLUDED)],
        F.countDistinct("yomi").alias("raw_readings"), F.countDistinct("reading", "surface").alias("runtime_entries"), F.countDistinct("reading").alias("runtime_readings"))


def _rank() -> Column:
    return F.when(F.col("status") == PRIMARY, 0).when(F.col("status") == REVIEW, 1).otherwise(2)


def _flag_text() -> Column:
    return F.when(F.size("flags") == 0, "-").otherwise(F.array_join("flags", ","))


def described() -> Column:
    """A candidate with its cost, status, score, flags, and what conversion would use instead."""
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    surface = F.when(F.col("norm_surface") != F.col("tango"), F.concat(lit("; runtime_surface="), "norm_surface")).otherwise("")
    cost = F.when(F.col("runtime_cost").isNotNull(), F.concat(lit("; runtime_cost="), text("runtime_cost"))).otherwise("")
    return F.concat("tango", lit(" [cost="), text("cost"), lit("; status="), F.lower("status"), lit("; score="), text("score"), lit("; flags="), _flag_text(), surface, cost, lit("]"))


def candidate_report(assessment: DataFrame) -> DataFrame:
    """For each reading as it stands: counts by status, and the candidates of each joined by bars, by runtime cost and surface.

    The candidates of a reading are one row, so they have to fit a task (2 GB of text).
    """
    item = F.struct(_rank().alias("k"), F.coalesce("runtime_cost", F.lit(2147483647)).alias("c"), "tango", "ord", described().alias("t"))
    listed = assessment.groupBy("yomi").agg(F.array_sort(F.collect_list(item)).alias("all"))
    of = lambda k: F.filter("all", lambda x: x["k"] == k)
    joined = lambda k: F.array_join(F.transform(of(k), lambda x: x["t"]), " | ")
    names = ("primary", "review", "excluded")
    return listed.select(
        F.col("yomi").alias("reading"), X.normalize_reading(F.col("yomi")).alias("normalized_reading"), F.size("all").alias("candidate_count"),
        *[F.size(of(k)).alias(f"{n}_count") for k, n in enumerate(names)], *[joined(k).alias(f"{n}_candidates") for k, n in enumerate(names)])


def quality_rows(assessment: DataFrame) -> DataFrame:
    """A row for each entry, numbered from 1 in source order, with its decision and flags."""
    numbered = ranked(assessment, "ord", "entry_index")
    return numbered.select(
        (F.col("entry_index") + 1).alias("entry_index"), F.col("yomi").alias("reading"), F.col("norm_reading").alias("normalized_reading"), F.col("tango").alias("english_candidate"),
        F.col("norm_surface").alias("normalized_surface"), F.col("cost").alias("source_cost"), "runtime_cost", F.lower("status").alias("status"), "score", _flag_text().alias("flags"))


def markdown_summary(assessment: DataFrame, source: str = "") -> str:
    """The counts of the dictionary and its quality, and the flag histogram, as a Markdown text."""
    whole, counts = dictionary_summary(assessment).first().asDict(), summary(assessment).first().asDict()
    flags = {r["flag"]: r["n"] for r in flag_counts(assessment).collect()}  # 17 flags at most
    whole |= {"duplicate_rows": whole["entries"] - whole["pairs"], "average_candidates": f"{whole['entries'] / whole['readings'] if whole['readings'] else 0:.3f}"}
    table = lambda rows: ["| what | n |", "| --- | ---: |", *(f"| {k.replace('_', ' ')} | {v} |" for k, v in rows)]
    head = ["# Reading dictionary", "", *([f"Source: {source}", ""] if source else [])]
    return "\n".join([*head, *table(whole.items()), "", "## Quality", "", *table(counts.items()), "", "## Flags", "", *table((f, flags[f]) for f in FLAGS if f in flags), ""])


def check(rows: DataFrame) -> dict[str, int]:
    """Counts of a reading dictionary; empty ones, pairs given twice and ones without runtime rows are errors."""
    assessment = assessed(rows)
    whole, quality = dictionary_summary(rows).first().asDict(), summary(assessment).first().asDict()
    if not whole["entries"]:
        raise ValidationError("the reading dictionary is empty")
    require_none(repeated(rows, ["yomi", "tango"]), "reading and surface given twice")
    if not quality["runtime_entries"]:
        raise ValidationError("no row of the reading dictionary can be used")
    require_none(assessed(runtime_rows(assessment).select(*rows.columns)).where(F.col("status") != PRIMARY), "runtime rows that are not primary")
    return whole | quality
