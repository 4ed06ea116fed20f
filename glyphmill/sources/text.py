"""Scans of line-based files.

Files are read in blocks, and lines are numbered by their block and their place in it, so that order
survives and a large file is read by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

DICTIONARY = "yomi string, left_id smallint, right_id smallint, cost smallint, tango string, src string, ord bigint"
# Zero-query types.
NONE, NUMBER_SUFFIX, EMOTICON, EMOJI = 0, 1, 2, 3


#: Lines that a place in a line may count up to in ``ord``, and files in a list.
PLACES, FILES = 1 << 24, 1 << 40


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, line_no from 1, value) in file order; a trailing line break ends the last line.

    Blocks of files are counted first (a row for each), which says where the numbers of a block begin.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    read = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = rows.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("__before", before).drop("__n")
    # within a block ids follow the lines, as one task reads it from its start to its end
    return rows.join(F.broadcast(starts), ["path", "__block"]).select("path", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("bigint").alias("line_no"), "value")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_no from 1, path) of the files under a directory, by their paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path")
    return found.withColumn("file_no", F.row_number().over(W.orderBy("path"))).select("file_no", "path")  # a row for each file


def _place(line_no: Column, place: Column) -> Column:
    """One number for a place in a line; a line of too many places is an error."""
    return F.when(place < PLACES, line_no * PLACES + place).otherwise(F.raise_error(F.lit("a line of too many parts")).cast("bigint"))


def _skipped() -> Column:
    v = X.trim_blank(F.col("value"))
    return F.col("value").isNull() | (v == "") | v.startswith("#")


def meaningful(df: DataFrame) -> DataFrame:
    """Without blank lines and comments."""
    return df.where(~_skipped())


def _checked(ok: Column, value: Column, message: str, comments: bool = True) -> Column:
    """The value, or an error with the file, line and text.

    Where files may have comments, blank and comment lines give null: the optimizer may move a
    check in front of the filter that takes them away.
    """
    checked = F.when(ok, value)
    if comments:
        checked = checked.when(_skipped(), None)
    return checked.otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.col("value"))))


def _short(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("smallint"))


def dictionary(spark: SparkSession, path: str | list[str], mode: str = "permissive", src: str | None = None) -> DataFrame:
    """Five-column dictionaries: reading, left id, right id, cost, surface.

    ``permissive`` drops rows of fewer fields; ``failfast`` raises for them.  A number that is not a short is
    an error in both.  Of a list of paths, ``ord`` follows the order of the list, then the lines.
    """
    if not isinstance(path, str):
        parts = [dictionary(spark, p, mode, src) for p in path]
        return reduce(DataFrame.unionByName, [d.withColumn("ord", F.col("ord") + i * FILES) for i, d in enumerate(parts)])
    f = F.split("value", "\t", 5)
    df = lines(spark, path)
    if mode == "permissive":
        df = df.where(F.size(f) == 5)
    elif mode == "failfast":
        df = df.withColumn("value", _checked(F.size(f) == 5, F.col("value"), "five fields are needed", False))
    else:
        raise ValueError(f"unknown mode: {mode}")
    numbers = [_short(F.get(f, F.lit(i))) for i in (1, 2, 3)]
    # the optimizer may move a check in front of the filter on short rows
    whole = F.size(f) == 5
    numbers = [F.when(~whole, None).otherwise(_checked(n.isNotNull(), n, "not a short number", False)) for n in numbers]
    return df.select(F.get(f, F.lit(0)).alias("yomi"), *[n.alias(c) for n, c in zip(numbers, ("left_id", "right_id", "cost"))], F.get(f, F.lit(4)).alias("tango"), F.lit(src).cast("string").alias("src") if src else F.col("path").alias("src"), F.col("line_no").alias("ord"))


def zipped_dictionary(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """One named entry of each zip file, as a failfast dictionary; a zip without it is an error."""
    import io
    import zipfile

    import pandas as pd

    def unzip(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if entry not in z.namelist():
                        raise FileNotFoundError(f"{entry} in {name}")
                    rows = z.read(entry).decode().splitlines()
                fields = [r.split("\t", 4) for r in rows]
                for i, f in enumerate(fields):
                    if len(f) != 5:
                        raise ValueError(f"five fields are needed: {name}:{i + 1}: {rows[i]}")
                yield pd.DataFrame([(f[0], int(f[1]), int(f[2]), int(f[3]), f[4], name, i + 1) for i, f in enumerate(fields)], columns=["yomi", "left_id", "right_id", "cost", "tango", "src", "ord"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, DICTIONARY)


def _entry(df: DataFrame, yomi: Column, tango: Column, context: int, cost: int, src: str) -> DataFrame:
    short = lambda n: F.lit(n).cast("smallint")
    return df.select(yomi.alias("yomi"), short(context).alias("left_id"), short(context).alias("right_id"), short(cost).alias("cost"), tango.alias("tango"), F.lit(src).alias("src"), F.col("ord").cast("bigint").alias("ord"))


def _readings(df: DataFrame, surface: Column, readings: Column) -> DataFrame:
    return df.select("line_no", surface.alias("tango"), F.posexplode(readings).alias("p", "yomi")).withColumn("ord", _place(F.col("line_no"), F.col("p")))


# Fixed values of the scans below: part-of-speech ids and costs.
SIGN_ID, NOUN_ID, KANJI_ID = 2641, 1851, 1916


def emoji(spark: SparkSession, path: str) -> DataFrame:
    """Sign, then columns of blank-separated readings; empty readings are kept."""
    f = F.split("value", "\t", -1)
    r = F.flatten(F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda c: F.split(X.trim_blank(c), " ", -1)))
    return _entry(_readings(lines(spark, path), F.get(f, F.lit(0)), r), F.col("yomi"), F.col("tango"), SIGN_ID, 6000, "emoji")


def emoticon(spark: SparkSession, path: str) -> DataFrame:
    """As emoji, but empty readings go and the cost is lower."""
    f = F.split("value", "\t", -1)
    r = F.flatten(F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda c: F.split(X.trim_blank(c), " ", -1)))
    return _entry(_readings(lines(spark, path), F.get(f, F.lit(0)), r).where("yomi <> ''"), F.col("yomi"), F.col("tango"), SIGN_ID, 4000, "emoticon")


def symbol(spark: SparkSession, path: str) -> DataFrame:
    """Sign, white space, blank-separated readings; blank lines go."""
    v = X.trim_blank(F.col("value"))
    f = F.split(v, r"\s+", 2)
    df = lines(spark, path).where((v != "") & (F.size(f) == 2))
    return _entry(_readings(df, F.get(f, F.lit(0)), F.split(F.get(f, F.lit(1)), " ", -1)).where("yomi <> ''"), F.col("yomi"), F.col("tango"), SIGN_ID, 4000, "symbol")


def proverb(spark: SparkSession, path: str) -> DataFrame:
    """Exactly (surface, reading)."""
    f = F.split("value", "\t", -1)
    return _entry(lines(spark, path).where(F.size(f) == 2).withColumn("ord", F.col("line_no")), F.get(f, F.lit(1)), F.get(f, F.lit(0)), NOUN_ID, 3000, "proverb")


def reading_correction(spark: SparkSession, path: str) -> DataFrame:
    """Exactly (surface, wrong reading, right reading); the surface carries the right reading after a tab."""
    f = F.split("value", "\t", -1)
    surface = F.concat_ws("\t", F.get(f, F.lit(0)), F.get(f, F.lit(2)))
    return _entry(lines(spark, path).where(F.size(f) == 3).withColumn("ord", F.col("line_no")), F.get(f, F.lit(1)), surface, NOUN_ID, 4000, "correction")


def single_kanji(spark: SparkSession, path: str, more: DataFrame | None = None) -> DataFrame:
    """Reading and a run of characters after a comma or tab; the last line of a reading wins; ``more`` rows follow."""
    f = F.split("value", "[,\t]", -1)
    df = lines(spark, path).where(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("yomi"), F.get(f, F.lit(1)).alias("run"), "line_no")
    last = df.groupBy("yomi").agg(F.max_by("run", "line_no").alias("run"), F.min("line_no").alias("line_no"))
    each = last.select("yomi", "line_no", F.posexplode(F.filter(F.split("run", ""), lambda c: c != "")).alias("p", "tango")).withColumn("ord", _place(F.col("line_no"), F.col("p")))
    out = _entry(each, F.col("yomi"), F.col("tango"), KANJI_ID, 5000, "single_kanji")
    return out.unionByName(more) if more is not None else out


def constant_table(spark: SparkSession, rows: list[tuple], src: str) -> DataFrame:
    """Rows (yomi, left_id, right_id, cost, tango) given in code, in their order."""
    return spark.createDataFrame([(*r[:5], src, i) for i, r in enumerate(rows)], DICTIONARY)


def english(spark: SparkSession, path: str, context_id: int | None = None) -> DataFrame:
    """The strict five-column reading dictionary with line numbers; every fault is an error."""
    f = F.split("value", "\t", -1)
    g = lambda i: F.get(f, F.lit(i))
    number = lambda i: _checked(g(i).rlike("^[+-]?[0-9]+$") & g(i).try_cast("int").isNotNull(), g(i).try_cast("int"), "not a number")
    df = meaningful(lines(spark, path))
    size = F.transform(f, lambda x: F.octet_length(x))
    whole = (F.size(f) == 5) & ~F.exists(f, lambda x: x == "") & (F.array_max(size) <= 256) & ~F.exists(f, lambda x: x.rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x9F]"))
    df = df.withColumn("value", _checked(whole, F.col("value"), "five fields of 1 to 256 bytes without control characters are needed"))
    ids = number(1).between(-32768, 32767) & number(2).between(-32768, 32767)
    if context_id is not None:
        ids = ids & (number(1) == context_id) & (number(2) == context_id)
    ok = ids & number(3).between(1, 32767)
    return df.select(g(0).alias("yomi"), *[_checked(ok, number(i), "id or cost out of range").cast("smallint").alias(c) for i, c in ((1, "left_id"), (2, "right_id"), (3, "cost"))], g(4).alias("tango"), F.lit("english").alias("src"), F.col("line_no").alias("ord"))


def connection_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, cost) from a size line and size squared short numbers, row by row; any fault is an error."""
    df = lines(spark, path)
    n = df.where("line_no = 1").select(F.col("path"), F.trim("value").try_cast("int").alias("n"))
    body = df.where("line_no > 1").join(F.broadcast(n), "path")  # a row for each file
    at = F.col("line_no") - 2
    ok = (F.col("n") > 0) & (at < F.col("n").cast("long") * F.col("n")) & F.col("value").rlike("^[+-]?[0-9]+$") & F.col("value").try_cast("smallint").isNotNull()
    cells = body.select("path", "n", at.alias("at"), _checked(ok, F.col("value").try_cast("smallint"), "not a matrix cell", False).alias("cost"))
    short = n.join(cells.groupBy("path").agg(F.count("cost").alias("c")), "path", "left").where(~((F.col("n") > 0) & (F.coalesce("c", F.lit(0)) == F.col("n").cast("long") * F.col("n"))) | F.col("n").isNull())
    if not short.isEmpty():
        raise ValueError(f"connection matrix of another size than its first line says: {path}")
    return cells.select(F.floor(F.col("at") / F.col("n")).cast("int").alias("left"), (F.col("at") % F.col("n")).cast("int").alias("right"), "cost")


def id_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, line_no) of ``<id> <name>`` lines; blank lines are faults too."""
    m = lambda i: F.regexp_extract("value", r"^([0-9]+)\s+(\S.*)$", i)
    ok = F.col("value").rlike(r"^[0-9]+\s+\S")
    return lines(spark, path).select(_checked(ok, m(1).try_cast("int"), "not an id and a name", False).alias("id"), m(2).alias("name"), "line_no")


def zero_query_rules(spark: SparkSession, path: str, kind: int = NONE, custom: bool = False) -> DataFrame:
    """(key, value, type, ord) of ``trigger<TAB>c1,c2`` lines; ``custom`` also refuses a candidate given twice."""
    f = F.split("value", "\t", -1)
    c = F.split(F.get(f, F.lit(1)), ",", -1)
    df = meaningful(lines(spark, path)).withColumn("value", _checked((F.size(f) == 2) & (F.get(f, F.lit(0)) != "") & ~F.exists(c, lambda x: x == ""), F.col("value"), "a trigger and candidates are needed"))
    out = df.select(F.get(f, F.lit(0)).alias("key"), F.posexplode(c).alias("p", "value"), F.lit(kind).cast("smallint").alias("type"), "line_no").select("key", "value", "type", _place(F.col("line_no"), F.col("p")).alias("ord"))
    if custom and not out.groupBy("key", "value").count().where("count > 1").isEmpty():
        raise ValueError(f"a custom trigger names a candidate twice: {path}")
    return out


def zero_query_numbers(spark: SparkSession, path: str) -> DataFrame:
    out = zero_query_rules(spark, path, NUMBER_SUFFIX)
    if out.where("key = 'default'").isEmpty():
        raise ValueError(f"the key 'default' is missing: {path}")
    return out


def zero_query_emoji(spark: SparkSession, path: str) -> DataFrame:
    """Readings of seven-column emoji lines from readings, Japanese name and descriptions; by value within a key."""
    f = F.split("value", "\t", -1)
    g = lambda i: F.get(f, F.lit(i))
    df = meaningful(lines(spark, path)).withColumn("value", _checked(F.size(f) == 7, F.col("value"), "seven columns are needed"))
    df = df.where(g(0) != "").select("line_no", g(1).alias("emoji"), X.nfkc_reading(g(2)).alias("r"), X.nfkc_reading(g(4)).alias("n"), X.nfkc_reading(g(5)).alias("d"))
    parts = lambda c: F.transform(F.split(c, r"[()/・]+", -1), X.remove_trailing_number)
    blank = lambda c: F.split(c, "[ 　]+", -1)
    keys = F.concat(blank(F.col("r")), parts(F.col("n")), F.flatten(F.transform(blank(F.col("d")), parts)))
    out = df.select("emoji", "line_no", F.posexplode(F.filter(F.array_distinct(keys), lambda k: k != "")).alias("p", "key"))
    w = F.row_number().over(_by_key("value", "line_no", "p"))
    return out.select("key", F.col("emoji").alias("value"), F.lit(EMOJI).cast("smallint").alias("type"), "line_no", "p").withColumn("ord", w.cast("bigint")).drop("line_no", "p")


def _by_key(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("key").orderBy(*order)


def zero_query_emoticons(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t", -1)
    df = meaningful(lines(spark, path)).withColumn("value", _checked(F.size(f) == 3, F.col("value"), "three columns are needed"))
    out = df.select(F.get(f, F.lit(0)).alias("value"), F.posexplode(F.split(X.trim_blank(F.get(f, F.lit(2))), "[ 　]+", -1)).alias("p", "key"), "line_no").where("key <> ''")
    return out.select("key", "value", F.lit(EMOTICON).cast("smallint").alias("type"), _place(F.col("line_no"), F.col("p")).alias("ord"))


def zero_query_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Single signs from U+2600 to U+2767 by readings, description and additional description."""
    f = F.split("value", "\t", -1)
    g = lambda i: F.get(f, F.lit(i))
    df = meaningful(lines(spark, path))
    head = df.groupBy("path").agg(F.min_by("value", "line_no").alias("value"))
    if head.isEmpty() or not head.where(~((F.size(f) >= 3) & (g(0) == "POS") & (g(1) == "CHAR"))).isEmpty():
        raise ValueError(f"the header is missing: {path}")
    df = df.withColumn("value", _checked(F.size(f) >= 3, F.col("value"), "three columns are needed")).where(g(0) != "POS")
    df = df.where((F.length(g(1)) == 1) & g(1).between("☀", "❧"))
    keys = F.concat(F.split(X.trim_blank(g(2)), "[ 　]+", -1), F.array(F.coalesce(g(3), F.lit("")), F.coalesce(g(4), F.lit(""))))
    out = df.select(g(1).alias("value"), F.posexplode(keys).alias("p", "key"), "line_no").where("key <> ''")
    return out.select("key", "value", F.lit(NONE).cast("smallint").alias("type"), _place(F.col("line_no"), F.col("p")).alias("ord"))


def generic_noun_id(defs: DataFrame) -> int:
    """The first id of a generic noun, or else of a noun."""
    part = F.split("name", ",")
    nouns = defs.where(F.get(part, F.lit(0)) == "名詞")
    found = nouns.agg(F.min(F.when(F.get(part, F.lit(1)) == "一般", F.col("id"))), F.min("id")).first()
    if found[1] is None:
        raise ValueError("the id definitions have no noun")
    return found[1] if found[0] is None else found[0]


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with a header line, unquoted, in the order of the frame."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns joined by tabs, one line a row, in the order of the frame; null is empty."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in df.schema.fields])).write.mode("overwrite").text(path)


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
