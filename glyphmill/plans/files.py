"""Registered queries of the scans, sinks and rule files: files written from the driver's tables, read by the library."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dictionary as D
from ..operators import ngram as N
from ..operators import quality as Q
from ..operators import validate as V
from ..operators import zeroquery as Z
from ..sources import binary as B
from ..sources import ngram_index as I
from ..sources import text as S
from . import jobs
from .queries import _t, query


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    return f"{D.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, order: str | None = None) -> str:
    """The folder with the column ``line`` as text files; with ``order`` one file in that order."""
    path = _folder(spark)
    out = lines.orderBy(order).coalesce(1) if order else lines
    out.select("line").write.text(path)
    return path


def _tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("line")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


_COST = "CAST(p_partkey % 30000 AS SMALLINT)"


def _five(p: DataFrame) -> Column:
    return _tabbed("p_name", "p_size", F.col("p_partkey") % 100, F.col("p_partkey") % 30000, "p_type", "p_brand")


# --- dictionaries ---------------------------------------------------------------------------------------------


@query(f"""SELECT p_name AS yomi, CAST(p_size AS SMALLINT) AS left_id, CAST(p_partkey % 100 AS SMALLINT) AS right_id, {_COST} AS cost, p_type || chr(9) || p_brand AS tango
    FROM part WHERE p_partkey % 7 <> 0""")
def scan_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-column lines, every seventh cut short: rows of fewer fields go, further tabs stay in the surface."""
    p = _part(spark, sf_dir)
    line = F.when(F.col("p_partkey") % 7 == 0, _tabbed("p_name", "p_size")).otherwise(_five(p)).alias("line")
    return S.dictionary(spark, _written(spark, p.select(line))).drop("src", "ord")


@query(f"""WITH l AS (SELECT p_name AS yomi, CAST(p_size AS SMALLINT) AS left_id, CAST(p_partkey % 100 AS SMALLINT) AS right_id, {_COST} AS cost, p_type || chr(9) || p_brand AS tango,
      CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS ord FROM part)
    SELECT * FROM l UNION ALL SELECT yomi, left_id, right_id, cost, tango, ord + {S.FILES} FROM l""")
def scan_dictionary_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of strict dictionaries, the same file twice: order is that of the list, then of the lines."""
    p = _part(spark, sf_dir)
    path = _written(spark, p.select("p_partkey", _five(p)), "p_partkey")
    return S.dictionary(spark, [path, path], "failfast").drop("src")


@query("""SELECT n_name AS yomi, CAST(n_regionkey AS SMALLINT) AS left_id, CAST(n_nationkey AS SMALLINT) AS right_id, CAST(n_nationkey * 3 AS SMALLINT) AS cost, n_name || '!' AS tango,
    CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS ord FROM nation""")
def scan_zipped_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of a zip file, made from the 25 nations."""
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    data, path = io.BytesIO(), f"{_folder(spark)}/nations.zip"
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.txt", "not this one")
        z.writestr("nations.txt", "".join(f"{r['n_name']}\t{r['n_regionkey']}\t{r['n_nationkey']}\t{r['n_nationkey'] * 3}\t{r['n_name']}!\n" for r in rows))
    B.write_file(spark, path, data.getvalue())
    return S.zipped_dictionary(spark, path, "nations.txt").drop("src")


_READINGS = "SELECT p_partkey, p_brand || '#' || p_partkey AS tango, unnest(string_split(p_name, ' ') || string_split(p_type || '  ' || p_size, ' ')) AS yomi FROM part"


def _sign_lines(spark: SparkSession, sf_dir: str) -> str:
    p = _part(spark, sf_dir)
    return _written(spark, p.select(_tabbed(F.concat("p_brand", F.lit("#"), F.col("p_partkey").cast("string")), F.concat(F.lit(" "), "p_name"), F.concat_ws("  ", "p_type", F.col("p_size").cast("string")))))


@query(f"SELECT yomi, tango, CAST({S.SIGN_ID} AS SMALLINT) AS left_id, CAST({S.SIGN_ID} AS SMALLINT) AS right_id, CAST(6000 AS SMALLINT) AS cost FROM ({_READINGS})")
def scan_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs with columns of readings; the empty reading between two blanks is kept."""
    return S.emoji(spark, _sign_lines(spark, sf_dir)).drop("src", "ord")


@query(f"SELECT yomi, tango, CAST({S.SIGN_ID} AS SMALLINT) AS left_id, CAST({S.SIGN_ID} AS SMALLINT) AS right_id, CAST(4000 AS SMALLINT) AS cost FROM ({_READINGS}) WHERE yomi <> ''")
def scan_emoticon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.emoticon(spark, _sign_lines(spark, sf_dir)).drop("src", "ord")


@query("""SELECT unnest(string_split(p_name, ' ')) AS yomi, p_brand || '#' || p_partkey AS tango, CAST(4000 AS SMALLINT) AS cost FROM part WHERE p_partkey % 5 <> 0""")
def scan_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign, white space, readings; a fifth of the lines are blank or have no reading."""
    p = _part(spark, sf_dir)
    sign = F.concat("p_brand", F.lit("#"), F.col("p_partkey").cast("string"))
    line = F.when(F.col("p_partkey") % 10 == 0, "  ").when(F.col("p_partkey") % 5 == 0, sign).otherwise(F.concat(F.lit(" "), sign, F.lit(" \t "), "p_name")).alias("line")
    return S.symbol(spark, _written(spark, p.select(line))).select("yomi", "tango", "cost")


@query("""SELECT p_name AS yomi, p_type AS tango, CAST(3000 AS SMALLINT) AS cost, 'proverb' AS src FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_brand, p_type || chr(9) || p_name, CAST(4000 AS SMALLINT), 'correction' FROM part WHERE p_partkey % 3 = 2""")
def scan_proverb_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one to three columns: those of two are proverbs, those of three corrections."""
    p, k = _part(spark, sf_dir), F.col("p_partkey") % 3
    path = _written(spark, p.select(F.when(k == 1, _tabbed("p_type", "p_name")).when(k == 2, _tabbed("p_type", "p_brand", "p_name")).otherwise(F.col("p_name")).alias("line")))
    return S.proverb(spark, path).unionByName(S.reading_correction(spark, path)).select("yomi", "tango", "cost", "src")


@query(f"""WITH l AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey DESC) AS k FROM part)
    SELECT p_type AS yomi, unnest(string_split(p_brand, '')) AS tango, CAST({S.KANJI_ID} AS SMALLINT) AS left_id, CAST(5000 AS SMALLINT) AS cost FROM l WHERE k = 1
    UNION ALL SELECT * FROM (VALUES ('more', 'm', CAST(1 AS SMALLINT), CAST(2 AS SMALLINT)), ('more', 'n', CAST(1 AS SMALLINT), CAST(3 AS SMALLINT)))""")
def scan_single_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of a reading wins, its run is cut into letters, and the rows of a table in the code follow."""
    p = _part(spark, sf_dir)
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(",", "p_type", "p_brand")).otherwise(F.concat_ws("\t", "p_type", "p_brand")).alias("line")
    path = _written(spark, p.select("p_partkey", line), "p_partkey")
    more = S.constant_table(spark, [("more", 1, 1, 2, "m"), ("more", 1, 1, 3, "n")], "code")
    return S.single_kanji(spark, path, more).select("yomi", "tango", "left_id", "cost")


@query(f"""SELECT p_name AS yomi, CAST({S.NOUN_ID} AS SMALLINT) AS left_id, CAST({S.NOUN_ID} AS SMALLINT) AS right_id, CAST(p_partkey % 32767 + 1 AS SMALLINT) AS cost, p_type AS tango, 'english' AS src,
    CAST(3 * row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS ord FROM part""")
def scan_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict reading dictionary; a comment and a blank line stand before each line and count in its number."""
    p = _part(spark, sf_dir)
    line = _tabbed("p_name", F.lit(S.NOUN_ID), F.lit(S.NOUN_ID), F.col("p_partkey") % 32767 + 1, "p_type")
    lines = p.select("p_partkey", F.posexplode(F.array(F.concat(F.lit("  # "), "p_name"), F.lit(" \t"), line)).alias("k", "line")).withColumn("o", F.col("p_partkey") * 3 + F.col("k"))
    return S.english(spark, _written(spark, lines, "o"), S.NOUN_ID)


@query("""SELECT doc_id, line_no, part_no, part FROM (
    SELECT doc_id, line_no, line, unnest(string_split(line, ' ')) AS part, unnest(range(0, len(string_split(line, ' ')))) AS part_no FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text <> ''))
    WHERE part <> '' AND trim(line) <> '' AND NOT starts_with(ltrim(line), '#')""")
def scan_meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: its lines with their numbers, without blank ones and comments, cut at blanks."""
    path = _folder(spark)
    docs = _t(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    # a file for each document would be many; a folder for each group of lines keeps the id in front of every line
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    numbered = lines.select((F.col("doc_id") * (1 << 20) + F.col("i")).alias("o"), F.concat_ws("\t", F.col("doc_id").cast("string"), (F.col("i") + 1).cast("string"), F.regexp_replace("x", "\r$", "")).alias("line"))
    numbered.repartitionByRange(8, "o").sortWithinPartitions("o").select("line").write.text(path)
    f = F.split("value", "\t", 3)
    found = S.lines(spark, path).select(F.get(f, F.lit(0)).cast("long").alias("doc_id"), F.get(f, F.lit(1)).cast("long").alias("line_no"), F.get(f, F.lit(2)).alias("value"))
    parts = S.meaningful(found).select("doc_id", "line_no", F.posexplode(X.split_keeping_empty(F.col("value"), " ")).alias("p", "part"))
    return parts.where("part <> ''").select("doc_id", "line_no", F.col("p").cast("long").alias("part_no"), "part")


@query("""SELECT row_number() OVER (ORDER BY r_name) AS file_no, r_name || '.part' AS name FROM region""")
def scan_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their paths: one for each of the five regions."""
    path = _folder(spark)
    for r in _t(spark, sf_dir, "region").collect():
        B.write_file(spark, f"{path}/{r['r_name']}.part", b"x")
        B.write_file(spark, f"{path}/{r['r_name']}.else", b"x")
    return S.files(spark, path, "*.part").select(F.col("file_no").cast("long").alias("file_no"), F.element_at(F.split("path", "/"), -1).alias("name"))


# --- matrices and ids -----------------------------------------------------------------------------------------

_GRID = """SELECT CAST(a.n_nationkey AS INTEGER) AS "left", CAST(b.n_nationkey AS INTEGER) AS "right", CAST(a.n_nationkey * 7 - b.n_nationkey * 3 + a.n_regionkey AS SMALLINT) AS cost FROM nation a CROSS JOIN nation b"""


def _grid_file(spark: SparkSession, sf_dir: str) -> str:
    """A matrix over the 25 nations as text."""
    n = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    path = f"{_folder(spark)}/matrix.txt"
    B.write_file(spark, path, "\n".join([str(len(n)), *(str(a["n_nationkey"] * 7 - b["n_nationkey"] * 3 + a["n_regionkey"]) for a in n for b in n), ""]).encode())
    return path


@query(_GRID)
def connection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection matrix of text: its size, then one cell a line."""
    return S.connection_matrix(spark, _grid_file(spark, sf_dir))


@query(_GRID)
def connection_matrix_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix written as raw shorts by the job, and read back."""
    raw = f"{_folder(spark)}/matrix.bin"
    jobs.write_matrix(spark, _grid_file(spark, sf_dir), raw)
    return B.read_matrix(spark, raw)


_DEFS = [("BOS/EOS,*,*,*,*,*,*", 0), ("名詞,一般", 1), ("名詞,数", 2), ("動詞,自立", 3)]


@query("""SELECT CAST(p_partkey AS INTEGER) AS id, p_type || ',' || p_partkey AS name, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS line_no FROM part""")
def scan_id_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    line = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("\t "), "p_type", F.lit(","), F.col("p_partkey").cast("string")).alias("line")
    return S.id_definitions(spark, _written(spark, p.select("p_partkey", line), "p_partkey"))


@query("""WITH d AS (SELECT CAST(p_partkey - p_partkey % 11 // 10 AS INTEGER) AS id, p_type || p_partkey // 2 AS name FROM part UNION ALL SELECT 0, 'wrong')
    SELECT 'id twice' AS fault, CAST(id AS VARCHAR) AS value FROM d GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'name twice', name FROM d GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'id missing', CAST(i AS VARCHAR) FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM d))) AS i) WHERE i NOT IN (SELECT id FROM d)
    UNION ALL SELECT 'name of 0', name FROM d WHERE id = 0""")
def id_definition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of id definitions in which ids and names repeat, ids are missing and id 0 has another name."""
    p = _part(spark, sf_dir)
    line = F.expr("concat(cast(p_partkey - (p_partkey % 11) div 10 as string), ' ', p_type, cast(p_partkey div 2 as string))").alias("line")
    return V.id_definitions(S.id_definitions(spark, _written(spark, p.select(line).union(spark.createDataFrame([("0 wrong",)], "line string")))))


# --- suggestion files -----------------------------------------------------------------------------------------


@query("""SELECT 'k' || p_partkey AS key, unnest([p_name, p_type, p_brand]) AS value, CAST(0 AS SMALLINT) AS type FROM part
    UNION ALL SELECT CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN 'default' ELSE CAST(p_partkey AS VARCHAR) END, unnest([p_name, p_type]), CAST(1 AS SMALLINT) FROM part""")
def zero_query_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines, of which custom ones may not repeat a candidate, and number lines with the key 'default'."""
    p = _part(spark, sf_dir)
    rule = F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("\t"), F.concat_ws(",", "p_name", "p_type", "p_brand"))
    rules = _written(spark, p.select(F.explode(F.array(F.lit("# comment"), F.lit(""), rule)).alias("line")))
    least = p.agg(F.min("p_partkey").alias("least"))
    number = F.concat(F.when(F.col("p_partkey") == F.col("least"), "default").otherwise(F.col("p_partkey").cast("string")), F.lit("\t"), F.concat_ws(",", "p_name", "p_type")).alias("line")
    numbers = _written(spark, p.join(least).select(number))
    return S.zero_query_rules(spark, rules, custom=True).unionByName(S.zero_query_numbers(spark, numbers)).drop("ord")


@query("""WITH p AS (SELECT *, 'e' || p_partkey AS emoji FROM part WHERE p_partkey % 9 <> 0),
    k AS (SELECT emoji, unnest(string_split(replace(p_name, '~', '〜'), ' ')) AS key FROM p
      UNION ALL SELECT emoji, regexp_replace(unnest(regexp_split_to_array(p_type || p_size || '(' || p_brand || ')', '[()/・]+')), '^([^0-9]+)[0-9]+$', '\\1') FROM p
      UNION ALL SELECT emoji, regexp_replace(unnest(regexp_split_to_array(d, '[()/・]+')), '^([^0-9]+)[0-9]+$', '\\1') FROM (SELECT emoji, unnest(string_split('か' || chr(12441) || p_size || '/ｱ~ ' || p_type, ' ')) AS raw FROM p) t,
        LATERAL (SELECT replace(replace(replace(raw, 'か' || chr(12441), 'が'), 'ｱ', 'ア'), '~', '〜') AS d))
    SELECT DISTINCT key, emoji AS value, CAST(3 AS SMALLINT) AS type FROM k WHERE key <> ''""")
def zero_query_emoji_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven columns: readings, name and descriptions in another normal form, with brackets, slashes and numbers."""
    p = _part(spark, sf_dir)
    code = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    name = F.concat("p_type", F.col("p_size").cast("string"), F.lit("("), "p_brand", F.lit(")"))
    described = F.concat(F.lit("が"), F.col("p_size").cast("string"), F.lit("/ｱ~　"), "p_type")
    return S.zero_query_emoji(spark, _written(spark, p.select(_tabbed(code, F.concat(F.lit("e"), F.col("p_partkey").cast("string")), "p_name", F.lit("NAME"), name, described, F.lit("1"))))).select("key", "value", "type")


@query("""SELECT unnest(string_split(p_name, ' ')) AS key, 'f' || p_partkey AS value, CAST(2 AS SMALLINT) AS type FROM part
    UNION ALL SELECT unnest(string_split(p_name, ' ') || [p_type, p_brand]), chr(CAST(9728 + p_partkey % 500 AS INTEGER)), CAST(0 AS SMALLINT) FROM part WHERE p_partkey % 500 <= 359""")
def zero_query_sign_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoticons with their readings, and signs with readings and descriptions, of which only a range of letters is taken."""
    p = _part(spark, sf_dir)
    faces = _written(spark, p.select(_tabbed(F.concat(F.lit("f"), F.col("p_partkey").cast("string")), "p_type", F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("　"))))))
    head = spark.createDataFrame([(-1, "POS\tCHAR\tReading\tdescription\tadditional")], "o long, line string")
    letter = F.decode(F.unhex(F.lpad(F.hex(F.lit(9728) + F.col("p_partkey") % 500), 4, "0")), "UTF-16BE")
    signs = _written(spark, head.union(p.select(F.col("p_partkey").alias("o"), _tabbed(F.lit("sign"), letter, "p_name", "p_type", "p_brand"))), "o")
    return S.zero_query_emoticons(spark, faces).unionByName(S.zero_query_symbols(spark, signs)).drop("ord")


@query("""SELECT 'k' || n_regionkey AS key, n_name AS value, CAST(n_nationkey % 4 AS SMALLINT) AS type, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS place FROM nation""")
def zero_query_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of the 25 nations written as binary tables, and read back."""
    place = F.row_number().over(Z.W.partitionBy("key").orderBy("n_nationkey"))
    entries = _t(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("key"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 4).cast("smallint").alias("type"), "n_nationkey").withColumn("place", place).drop("n_nationkey")
    path = _folder(spark)
    B.write_suggestions(entries, f"{path}/tokens", f"{path}/strings")
    return B.read_suggestions(spark, f"{path}/tokens", f"{path}/strings")


# --- rule files -----------------------------------------------------------------------------------------------


def _rule_files(spark: SparkSession, sf_dir: str) -> str:
    """A word list for each region, of which the second includes the first, and rule files that name them."""
    regions = [r["r_name"] for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    names = {k: [] for k in range(len(regions))}
    for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        names[r["n_regionkey"]].append(r["n_name"])
    path = _folder(spark)
    for k, region in enumerate(regions):
        inner = f'@include "../lists/{k - 1}.words"\n' if k == 1 else ""
        B.write_file(spark, f"{path}/lists/{k}.words", ("# words\n\n" + inner + "\n".join([*names[k], *names[k][:1]]) + "\n").encode())
        B.write_file(spark, f"{path}/rules/{k}.ngram", f'# rules\nwords("../lists/{k}.words") + "が" + * + pos("{region}")\n"{region}" + words("../lists/{k}.words")\n'.encode())
    return path


_RULES = """WITH w AS (SELECT n_regionkey AS k, n_name AS w FROM nation UNION ALL SELECT 1, n_name FROM nation WHERE n_regionkey = 0),
    r AS (SELECT 'rules/' || k || '.ngram' AS source, 2 AS line_no, 'W:' || w || '|W:が|*|P:' || r_name AS rule FROM w JOIN region ON r_regionkey = k
      UNION ALL SELECT 'rules/' || k || '.ngram', 3, 'W:' || r_name || '|W:' || w FROM w JOIN region ON r_regionkey = k)"""


@query(f"{_RULES} SELECT rule, source, CAST(line_no AS INTEGER) AS line_no FROM r")
def ngram_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files with word lists that include each other, parsed and multiplied out."""
    return N.rules_from(spark, _rule_files(spark, sf_dir)).select(X.canonical(F.col("features")).alias("rule"), "source", "line_no")


@query("""SELECT 'W:' || r_name AS rule, 2 AS n FROM region""")
def ngram_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-word rules that stand in two places."""
    rows = _t(spark, sf_dir, "region").select(F.array(F.struct(F.lit(1).alias("kind"), F.col("r_name").alias("value"))).alias("features"), F.lit("x").alias("source"), F.col("r_regionkey").alias("line_no"))
    return N.duplicates(rows.union(rows)).select("rule", F.col("n").cast("int").alias("n"))


@query(f"{_RULES} SELECT count(*) AS rules, 0::BIGINT AS order_1, count(*) FILTER (line_no = 3) AS order_2, 0::BIGINT AS order_3, count(*) FILTER (line_no = 2) AS order_4, 0::BIGINT AS order_5, 2::BIGINT AS signatures, (SELECT count(DISTINCT w) + 6 FROM w) AS words FROM r")
def ngram_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.build_report(N.rules_from(spark, _rule_files(spark, sf_dir)))


@query(f"{_RULES} SELECT replace(replace(replace(replace(replace(rule, 'P:AFRICA', 'P:1'), 'P:AMERICA', 'P:2'), 'P:ASIA', 'P:3'), 'P:EUROPE', 'P:4'), 'P:MIDDLE EAST', 'P:5') AS rule FROM r")
def ngram_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules packed into one index and read back; parts of speech are the numbers of their classes."""
    defs = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat("r_name", F.lit(",x")).alias("name"))
    path = f"{_folder(spark)}/rules.bin"
    I.write(N.rules_from(spark, _rule_files(spark, sf_dir)), defs, path)
    return I.read(spark, path).select(X.canonical(F.col("features")).alias("rule"))


# --- functions and tables of kana -----------------------------------------------------------------------------
# Part keys as kana: digits become hiragana; the surface is the same, katakana, both, or a text.

_HIRA, _KATA = "あいうえおかきくけこ", "アイウエオカキクケコ"
_KANA = f"""WITH w AS (SELECT translate(CAST(p_partkey AS VARCHAR), '0123456789', '{_HIRA}') AS h, translate(CAST(p_partkey AS VARCHAR), '0123456789', '{_KATA}') AS k, * FROM part),
    v AS (SELECT h || CASE WHEN p_partkey % 3 = 0 THEN 'が' ELSE '' END AS yomi, CASE p_partkey % 5 WHEN 0 THEN h || CASE WHEN p_partkey % 3 = 0 THEN 'が' ELSE '' END WHEN 1 THEN k || CASE WHEN p_partkey % 2 = 0 THEN 'ー' ELSE 'ガ' END WHEN 2 THEN h || k WHEN 3 THEN p_name ELSE h || 'ヴゔ' END AS tango,
      p_size % 9 AS l, p_partkey % 4 AS r, p_partkey, p_size FROM w),
    kinds AS (SELECT *, CASE WHEN yomi = tango OR regexp_matches(tango, '^[{X.HIRAGANA}]+$') THEN 'reading' WHEN regexp_matches(tango, '^[{X.KATAKANA}]+$') THEN 'katakana' ELSE 'text' END AS kind FROM v)"""


def _kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and surfaces; a third of the readings, and half of the marks, are written in decomposed form."""
    p = _part(spark, sf_dir)
    digits = lambda to: F.translate(F.col("p_partkey").cast("string"), "0123456789", to)
    h, k, n = digits(_HIRA), digits(_KATA), F.col("p_partkey")
    reading = F.concat(h, F.when(n % 3 == 0, "が").otherwise(""))
    tango = F.when(n % 5 == 0, reading).when(n % 5 == 1, F.concat(k, F.when(n % 2 == 0, "ー").otherwise("ガ"))).when(n % 5 == 2, F.concat(h, k)).when(n % 5 == 3, F.col("p_name")).otherwise(F.concat(h, F.lit("ヴゔ")))
    return p.select("p_partkey", X.nfc(reading).alias("yomi"), tango.alias("tango"), (F.col("p_size") % 9).cast("smallint").alias("left_id"), (n % 4).cast("smallint").alias("right_id"), F.col("p_size").cast("smallint").alias("cost"), n.alias("ord"))


@query(f"""{_KANA} SELECT p_partkey, yomi, tango, regexp_matches(tango, '^[{X.HIRAGANA}]+$') AS hiragana, regexp_matches(tango, '^[{X.KATAKANA}]+$') AS katakana,
    regexp_matches(tango, '^([{X.HIRAGANA}]+|[{X.KATAKANA}]+)$') AS kana, regexp_matches(tango, '^[{X.HIRAGANA}{X.KATAKANA}]+$') AS mixed, kind,
    CASE kind WHEN 'reading' THEN yomi WHEN 'katakana' THEN translate(yomi, '{X._HIRA_RUN}', '{X._KATA_RUN}') ELSE tango END AS shown FROM kinds""")
def surface_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of kana a surface is, after composing it, and what conversion shows for it."""
    rows, tango = _kana(spark, sf_dir), F.col("tango")
    kind = X.surface_kind(F.col("yomi"), tango)
    return rows.select(
        "p_partkey", "yomi", X.nfc(tango).alias("tango"), X.is_hiragana(tango).alias("hiragana"), X.is_katakana(tango).alias("katakana"), X.is_kana(tango).alias("kana"), X.is_kana(tango, mixed=True).alias("mixed"),
        kind.alias("kind"), X.decoded_surface(kind, F.col("yomi"), X.nfc(tango)).alias("shown"))


@query(f"""{_KANA}, keys AS (SELECT yomi, row_number() OVER (ORDER BY length(yomi), yomi) - 1 AS key_id FROM (SELECT DISTINCT yomi FROM v)),
    j AS (SELECT kinds.*, key_id FROM kinds JOIN keys USING (yomi)), f AS (SELECT l, r, min(key_id * 1000000000 + p_partkey) AS first FROM j GROUP BY ALL),
    pairs AS (SELECT l, r, row_number() OVER (ORDER BY first DESC) - 1 AS pair_id FROM f)
    SELECT key_id, CAST(pair_id AS INTEGER) AS pair_id, CAST(p_size AS SMALLINT) AS cost, kind AS surface_kind, CASE WHEN kind = 'text' THEN tango END AS surface, p_partkey AS ord FROM j JOIN pairs USING (l, r)""")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows as ids of readings and context pairs, kana surfaces left out."""
    return D.token_table(_kana(spark, sf_dir), ["ord"]).withColumn("key_id", F.col("key_id").cast("long")).withColumn("surface", X.nfc(F.col("surface")))


@query(f"""{_KANA} SELECT yomi, row_number() OVER (ORDER BY length(yomi), yomi) - 1 AS place FROM (SELECT DISTINCT yomi FROM v)""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by their length, then letters."""
    rows = _kana(spark, sf_dir).select("yomi").distinct()
    return D.ranked(rows, [X.utf16_length(F.col("yomi")), X.utf16_order(F.col("yomi"))], "place").withColumn("place", F.col("place").cast("long"))


@query("""SELECT p_type AS yomi, string_agg(p_name, ',' ORDER BY p_size, p_name, p_partkey) AS names FROM part GROUP BY p_type""")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a reading by cost, then surface."""
    rows = _part(spark, sf_dir).select(F.col("p_type").alias("yomi"), "p_name", "p_size", "p_partkey")
    return D.group_ordered(rows, "yomi", ["p_name"], ["p_size", "p_name", "p_partkey"]).select("yomi", F.array_join(F.transform("entries", lambda e: e["p_name"]), ",").alias("names"))


@query("""WITH k AS (SELECT yomi, row_number() OVER (ORDER BY yomi) - 1 AS id FROM (SELECT DISTINCT p_name AS yomi FROM part)),
    a AS (SELECT DISTINCT unnest([p_name, left(p_name, 4), p_brand, p_name || 'x', '']) AS word FROM part)
    SELECT word, id, EXISTS (SELECT 1 FROM k WHERE starts_with(k.yomi, word)) AS begins FROM a LEFT JOIN k ON yomi = word""")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up among the part names, and whether a name begins with them."""
    p = _part(spark, sf_dir)
    asked = p.select(F.explode(F.array(F.col("p_name"), F.substring("p_name", 1, 4), F.col("p_brand"), F.concat("p_name", F.lit("x")), F.lit(""))).alias("word"))
    return D.lookup(asked, "word", p, "p_name").withColumn("id", F.col("id").cast("long"))


@query("""WITH k AS (SELECT yomi, row_number() OVER (ORDER BY yomi) - 1 AS id FROM (SELECT DISTINCT p_name AS yomi FROM part)) SELECT DISTINCT p_partkey AS id, yomi AS word FROM part LEFT JOIN k ON id = p_partkey""")
def key_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by their numbers; a number beyond them has none."""
    p = _part(spark, sf_dir)
    return D.restored(p, "p_partkey", p, "p_name")


_MOD = "18446744073709551616"


def _times(h: str, m: int) -> str:
    """h * m modulo 2^64 in steps that fit 127 bits."""
    m &= (1 << 64) - 1
    return f"((({h} * {m >> 32}::HUGEINT) % {_MOD}::HUGEINT * 4294967296::HUGEINT) + {h} * {m & 0xFFFFFFFF}::HUGEINT) % {_MOD}::HUGEINT"


_FOLD = "xor(h, h // 8589934592::HUGEINT)"


@query(f"""WITH b AS (SELECT p_partkey, list_transform(range(0, CAST(octet_length(encode(p_name)) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(p_name)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT)::HUGEINT) AS bytes FROM part),
    a AS (SELECT p_partkey, list_reduce(list_prepend({-3750763034362895579 & (1 << 64) - 1}::HUGEINT, bytes), lambda h, x: {_times("xor(h, x)", 1099511628211)}) AS h FROM b),
    c AS (SELECT p_partkey, {_FOLD} AS h FROM a), d AS (SELECT p_partkey, {_times("h", -49064778989728563)} AS h FROM c), e AS (SELECT p_partkey, {_FOLD} AS h FROM d),
    f AS (SELECT p_partkey, {_times("h", -4265267296055464877)} AS h FROM e), g AS (SELECT p_partkey, {_FOLD} AS h FROM f)
    SELECT p_partkey, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {_MOD}::HUGEINT ELSE h END AS BIGINT) AS hash FROM g""")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit hash of packed keys, over the part names."""
    return _part(spark, sf_dir).select("p_partkey", X.hash64(F.encode("p_name", "UTF-8")).alias("hash"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(x, '^[^0-9]+[0-9]+$') THEN regexp_replace(x, '[0-9]+$', '') ELSE x END AS name,
    array_to_string(list_transform(regexp_split_to_array(x || '/' || p_brand || '・1(' || p_type || '2)', '[()/・]+'), lambda y: regexp_replace(y, '^([^0-9]+)[0-9]+$', '\\1')), '|') AS readings FROM (SELECT *, p_name || p_size AS x FROM part)""")
def description_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without the number behind them, and the readings of a description."""
    x = F.concat("p_name", F.col("p_size").cast("string"))
    described = F.concat(x, F.lit("/"), "p_brand", F.lit("・1("), "p_type", F.lit("2)"))
    return _part(spark, sf_dir).select("p_partkey", X.remove_trailing_number(x).alias("name"), F.array_join(X.description_readings(described), "|").alias("readings"))


# --- sinks and jobs -------------------------------------------------------------------------------------------


@query(f"""{_KANA} SELECT yomi, tango, kind AS surface_kind, src_rank FROM (SELECT yomi, tango, kind, 0 AS src_rank FROM kinds WHERE p_partkey % 2 = 0
    UNION ALL SELECT yomi, tango, kind, 1 FROM kinds WHERE p_partkey % 2 = 1 AND (yomi, tango) NOT IN (SELECT (yomi, tango) FROM kinds WHERE p_partkey % 2 = 0))""")
def dictionary_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that builds a dictionary from files, and adds the pairs of another one that are new."""
    rows = _kana(spark, sf_dir).withColumn("tango", X.nfc(F.col("tango")))
    file = lambda odd: _written(spark, rows.where(F.col("ord") % 2 == odd).select("ord", _tabbed("yomi", "left_id", "right_id", "cost", "tango")), "ord")
    return jobs.build_dictionary(spark, [file(0)], _folder(spark), missing=file(1)).select("yomi", "tango", "surface_kind", "src_rank")


@query("""SELECT count(*) AS entries, count(DISTINCT p_partkey) AS readings FROM part""")
def english_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict scan and check of a reading dictionary, as the job does it: counts of a clean one."""
    p = _part(spark, sf_dir)
    digits = F.translate(F.col("p_partkey").cast("string"), "0123456789", "あいうえおかきくけこ")
    line = _tabbed(F.concat(F.lit("さ"), digits), F.lit(S.NOUN_ID), F.lit(S.NOUN_ID), F.lit(5), F.regexp_replace("p_name", "[^a-z]", ""))
    found = jobs.validate_english(spark, _written(spark, p.select(line)))
    return spark.createDataFrame([(found["entries"], found["readings"])], "entries long, readings long")
