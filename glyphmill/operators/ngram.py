"""N-gram rules: parsing, expansion, checks, and matching of sequences."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

RULE = "features array<struct<kind:int,value:string>>, source string, line_no int"
#: Rules that one line may expand to.
MOST = 100_000
#: Bytes of word lists that are shipped with a parser.
LISTS = 64 << 20
_ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "t": "\t"}


class RuleError(ValueError):
    """A fault in a rule file, with its place."""


def split_features(line: str) -> list[str]:
    """Parts of a rule between the plus signs outside quotes and parentheses."""
    parts, depth, quoted, skip, start = [], 0, False, False, 0
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise RuleError("a parenthesis is closed that is not open")
        elif c == "+" and not depth:
            parts.append(line[start:i].strip())
            start = i + 1
    if quoted or depth:
        raise RuleError("a quote or parenthesis is open")
    parts.append(line[start:].strip())
    if "" in parts:
        raise RuleError("a feature is empty")
    return parts


def unquoted(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        raise RuleError(f"a quoted text is needed: {text}")
    out, rest = [], iter(text[1:-1])
    for c in rest:
        if c == '"':
            raise RuleError(f"a quote within a text: {text}")
        if c == "\\" and (c := _ESCAPES.get(next(rest, ""), "")) == "":
            raise RuleError(f"an unknown escape: {text}")
        out.append(c)
    return "".join(out)


def word_list(name: str, read: Callable[[str], str], seen: tuple[str, ...] = (), known: dict | None = None) -> list[str]:
    """Words of a list and of what it includes, in order, each once; files stay under the root and do not include themselves."""
    known = {} if known is None else known
    path = os.path.normpath(name)
    if not path.endswith(".words") or os.path.isabs(path) or path.startswith(".."):
        raise RuleError(f"not a word list under the root: {name}")
    if path in seen:
        raise RuleError(f"word lists include each other: {' -> '.join((*seen, path))}")
    if path not in known:
        words: dict[str, None] = {}
        for raw in read(path).splitlines():
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            if m := re.fullmatch(r'@include\s+(".*")', line):
                inner = os.path.join(os.path.dirname(path), unquoted(m[1]))
                words |= dict.fromkeys(word_list(inner, read, (*seen, path), known))
            elif "\0" in line:
                raise RuleError(f"a word holds a zero character: {path}")
            else:
                words[unicodedata.normalize("NFC", line)] = None
        if not words:
            raise RuleError(f"an empty word list: {path}")
        known[path] = list(words)
    return known[path]


def parse_rule(line: str, read: Callable[[str], str], base: str = "", orders: tuple[int, int] = (2, 5)) -> list[list[tuple[int, str]]]:
    """The rules, as (kind, value) features, that a line expands to."""
    if re.search(r"\b(?:score|cost|adjustment)\b", re.sub(r'"(?:\\.|[^"\\])*"', "", line)):
        raise RuleError("rules have no scores")
    slots = []
    for part in split_features(line):
        if part == "*":
            slots.append([(X.KINDS["any"], "")])
        elif m := re.fullmatch(r"pos\(\s*(\".*\")\s*\)", part):
            slots.append([(X.KINDS["pos"], unquoted(m[1]))])
        elif m := re.fullmatch(r"words\(\s*(\".*\")\s*\)", part):
            slots.append([(X.KINDS["word"], w) for w in word_list(os.path.join(base, unquoted(m[1])), read)])
        else:
            slots.append([(X.KINDS["word"], unicodedata.normalize("NFC", unquoted(part)))])
        if any(k != X.KINDS["any"] and not v for k, v in slots[-1]):
            raise RuleError("an empty word or part of speech")
    if not orders[0] <= len(slots) <= orders[1]:
        raise RuleError(f"{len(slots)} features; {orders[0]} to {orders[1]} are allowed")
    if orders == (1, 1) and any(k != X.KINDS["word"] for s in slots for k, _ in s):
        raise RuleError("single rules are words only")
    total = reduce(lambda a, s: a * len(s), slots, 1)
    if total > MOST:
        raise RuleError(f"{total} rules from one line; {MOST} are allowed")
    return [list(x) for x in product(*slots)]


def rules_from(spark: SparkSession, path: str, unigrams: bool = False) -> DataFrame:
    """Rules of all ``*.ngram`` files under a directory, word lists beside them; a rule given twice is an error with its places.

    Files are read by Spark, and lines are parsed where they are; the word lists, which are small, are shipped along.
    """
    from ..sources.text import lines, meaningful

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    words = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.words").text(path, wholetext=True).select("_metadata.file_path", "_metadata.file_size", "value")
    size = words.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    if size > LISTS:
        raise RuleError(f"word lists of {size} bytes; {LISTS} are allowed")
    texts = words.select("file_path", "value").collect()
    plain = lambda p: re.sub("^file:/+", "/", p)
    lists = {plain(p)[len(plain(root)) :]: v for p, v in texts}
    orders = (1, 1) if unigrams else (2, 5)

    def parse(rows):
        import pandas as pd

        def read(name: str) -> str:
            if name not in lists:
                raise RuleError(f"no word list {name}")
            return lists[name]

        for part in rows:
            out = []
            for file, n, line in zip(part["path"], part["line_no"], part["value"]):
                relative = plain(file)[len(plain(root)) :]
                try:
                    found = parse_rule(line.strip(), read, os.path.dirname(relative), orders)
                except RuleError as e:
                    raise RuleError(f"{relative}:{n}: {e}: {line}") from None
                out += [([{"kind": k, "value": v} for k, v in r], relative, n) for r in found]
            yield pd.DataFrame(out, columns=["features", "source", "line_no"])

    rules = meaningful(lines(spark, path, "*.ngram", True)).mapInPandas(parse, RULE)
    twice = duplicates(rules)
    if first := twice.head():
        raise RuleError(f"a rule is given {first['n']} times: {first['rule']}: {first['places']}")
    return rules


def duplicates(rules: DataFrame) -> DataFrame:
    """(rule, n, places) of rules that stand more than once."""
    place = F.concat_ws(":", "source", F.col("line_no").cast("string"))
    return rules.groupBy(X.canonical(F.col("features")).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(place)), ", ").alias("places")).where("n > 1")


def build_report(rules: DataFrame) -> DataFrame:
    """One row: rules, rules of each order, distinct signatures and words."""
    sig = X.signature(F.transform("features", lambda f: f["kind"]))
    words = F.filter("features", lambda f: f["kind"] == X.KINDS["word"])
    one = rules.select(F.size("features").alias("n"), sig.alias("sig"), F.transform(words, lambda f: f["value"]).alias("w"))
    counts = one.agg(F.count(F.lit(1)).alias("rules"), *[F.count_if(F.col("n") == k).alias(f"order_{k}") for k in range(1, 6)], F.countDistinct("sig").alias("signatures"))
    return counts.join(one.select(F.explode("w").alias("x")).agg(F.countDistinct("x").alias("words")))  # two single rows


def compiled(rules: DataFrame, beginnings: bool = False) -> DataFrame:
    """Rules with their signature, key and order, refused outside orders 1 to 5 or if single rules are not words (unless they are beginnings)."""
    kinds = F.transform("features", lambda f: f["kind"])
    n = F.size("features")
    ok = n.between(1, 5) & (F.lit(beginnings) | (n > 1) | (F.get(kinds, F.lit(0)) == X.KINDS["word"]))
    checked = F.when(ok, n).otherwise(F.raise_error(F.lit("a rule of an order that cannot be matched")).cast("int"))
    return rules.select("features", checked.alias("n"), X.signature(kinds).alias("signature"), X.canonical(F.col("features")).alias("rule"))


def matching_windows(tokens: DataFrame, rules: DataFrame, by: list[str], order: str, word: str, pos: str | None = None, beginnings: bool = False) -> DataFrame:
    """(by, order, rule): where a rule matches the sequence of tokens that begins there.

    One pass: the next four tokens come from a window; each signature in use (at most a few
    dozen) makes one key, and one equi-join looks all keys up.
    """
    made = compiled(rules, beginnings)
    signatures = [r[0] for r in made.select("signature").distinct().collect()]  # at most 363
    w = W.partitionBy(*by).orderBy(order)
    ahead = tokens.select(*by, order, *[F.lead(word, k).over(w).alias(f"w{k}") for k in range(5)], *[(F.lead(pos, k).over(w) if pos else F.lit(None).cast("string")).alias(f"p{k}") for k in range(5)])
    keys = []
    for s in signatures:
        n, parts, ok = s & 7, [], F.lit(True)
        for k in range(n):
            kind = s >> (3 + 2 * k) & 3
            value = {1: F.concat(F.lit("W:"), F.col(f"w{k}")), 2: F.concat(F.lit("P:"), F.col(f"p{k}")), 3: F.lit("*")}[kind]
            ok = ok & F.col(f"w{k}").isNotNull() & (F.col(f"p{k}").isNotNull() if kind == 2 else F.lit(True))
            parts.append(value)
        keys.append(F.when(ok, F.concat_ws("|", *parts)))
    if not keys:
        return ahead.select(*by, order, F.lit("").alias("rule")).where(F.lit(False))
    looked = ahead.select(*by, order, F.explode(F.array_compact(F.array(*keys))).alias("rule"))
    return looked.join(made.select("rule").distinct(), "rule", "left_semi").select(*by, order, "rule")


def may_begin(tokens: DataFrame, rules: DataFrame, by: list[str], order: str, word: str, pos: str | None = None, nodes: int = 2) -> DataFrame:
    """(by, order) of the places where the first one or two features of a rule match: no rule begins anywhere else."""
    begin = rules.select(F.slice("features", 1, nodes).alias("features")).distinct()
    return matching_windows(tokens, begin, by, order, word, pos, True).select(*by, order).distinct()


def matching_paths(ranked: DataFrame, rules: DataFrame, pos: DataFrame | None = None) -> DataFrame:
    """(input, rank) of the paths that a rule matches anywhere; ``pos`` (id, name) gives the coarse part of speech of a left id."""
    nodes = ranked.select("input", "rank", F.posexplode("path").alias("at", "node")).select("input", "rank", "at", X.nfc(F.col("node.value")).alias("word"), F.col("node.lid").alias("id"))
    if pos is not None:
        nodes = nodes.join(pos.select("id", F.split("name", ",")[0].alias("pos")), "id", "left")
    return matching_windows(nodes, rules, ["input", "rank"], "at", "word", "pos" if pos is not None else None).select("input", "rank").distinct()


def coarse_classes(pos: DataFrame) -> DataFrame:
    """(name, id from 1) of the coarse parts of speech; fewer than 256."""
    names = pos.select(F.split("name", ",")[0].alias("name")).distinct()
    out = names.withColumn("id", F.row_number().over(W.orderBy(X.utf16_order(F.col("name")))))
    return out.withColumn("id", F.when(F.col("id") < 256, F.col("id")).otherwise(F.raise_error(F.lit("256 or more coarse parts of speech")).cast("int")))
