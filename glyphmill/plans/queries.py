"""Registered queries: each operator on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dictionary as D
from ..operators import lattice as L
from ..operators import ngram as N
from ..operators import quality as Q
from ..operators import validate as V
from ..operators import zeroquery as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than the session has cores is dealt over the cores; a larger one is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


# --- lattices -------------------------------------------------------------------------------------------------
# The dictionary of the part names: their pieces of one to three letters, with ids and costs made from their letters.


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select("p_name").distinct()
    at = names.select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name"))).alias("i")).select("p_name", "i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    key = at.where("i + n - 1 <= length(p_name)").select(F.expr("substring(p_name, i, n)").alias("yomi")).distinct()
    return key.select(
        "yomi", F.expr("cast(ascii(yomi) % 7 + 1 as smallint)").alias("left_id"), F.expr("cast(ascii(right(yomi, 1)) % 5 + 1 as smallint)").alias("right_id"),
        F.expr("cast(20 + (ascii(yomi) * 3 + length(yomi) * 11) % 50 as smallint)").alias("cost"), F.concat("yomi", F.lit("/")).alias("tango"), F.lit("pieces").alias("src"), F.lit(0).cast("bigint").alias("ord"))


def _connection(spark: SparkSession) -> DataFrame:
    """Costs (left * 7 + right * 3) mod 11 of ids 0 to 9."""
    ids = spark.range(100)
    return ids.select((F.col("id") / 10).cast("int").alias("left"), (F.col("id") % 10).cast("int").alias("right")).withColumn("cost", ((F.col("left") * 7 + F.col("right") * 3) % 11).cast("smallint"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_name").alias("input"))


_LATTICE = """names AS (SELECT DISTINCT p_name AS input FROM part),
    dict AS (SELECT yomi, ascii(yomi) % 7 + 1 AS l, ascii(right(yomi, 1)) % 5 + 1 AS r, 20 + (ascii(yomi) * 3 + length(yomi) * 11) % 50 AS w, yomi || '/' AS tango
             FROM (SELECT DISTINCT substr(input, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS yomi
                   FROM names, (SELECT unnest(range(1, 60)) AS i), (SELECT unnest(range(1, 4)) AS n) WHERE i + n - 1 <= length(input))),
    edges AS (SELECT input, s, s + length(yomi) AS e, yomi AS key, tango, l, r, w
              FROM names, (SELECT unnest(range(0, 60)) AS s), dict WHERE s < length(input) AND substr(input, CAST(s + 1 AS INTEGER), CAST(length(yomi) AS INTEGER)) = yomi)"""
_PATHS = f"""WITH RECURSIVE {_LATTICE},
    p AS (SELECT input, e, r, w + (l * 3) % 11 AS cost, tango AS surface FROM edges WHERE s = 0
          UNION ALL
          SELECT p.input, d.e, d.r, p.cost + d.w + (p.r * 7 + d.l * 3) % 11, p.surface || d.tango FROM p JOIN edges d ON p.input = d.input AND p.e = d.s),
    done AS (SELECT input, surface, min(cost + (r * 7) % 11) AS cost FROM p WHERE e = length(input) GROUP BY ALL),
    ranked AS (SELECT input, surface, CAST(cost AS INTEGER) AS cost, CAST(row_number() OVER (PARTITION BY input ORDER BY cost, surface) AS INTEGER) AS rank FROM done)"""


@query(f"WITH {_LATTICE} SELECT input, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, key, tango, CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r, CAST(w AS INTEGER) AS w FROM edges")
def prefix_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prefix_edges(_names(spark, sf_dir), _pieces(spark, sf_dir)).drop("ord")


@query(f"""WITH {_LATTICE} SELECT a.input, CAST(a.s AS INTEGER) AS s, CAST(a.e AS INTEGER) AS m, CAST(b.e AS INTEGER) AS e, a.key AS left_key, b.key AS right_key,
    CAST((a.r * 7 + b.l * 3) % 11 AS INTEGER) AS cost FROM edges a JOIN edges b ON a.input = b.input AND a.e = b.s""")
def lattice_adjacency_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.adjacency(L.prefix_edges(_names(spark, sf_dir), _pieces(spark, sf_dir)), _connection(spark)).select("input", "s", "m", "e", "left_key", "right_key", "cost")


@query(f"{_PATHS} SELECT input, cost FROM ranked WHERE rank = 1")
def viterbi_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.convert(_names(spark, sf_dir), _pieces(spark, sf_dir), _connection(spark)).select("input", "cost")


@query(f"{_PATHS} SELECT input, rank, surface, cost FROM ranked WHERE rank <= 5")
def nbest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = L.prefix_edges(_names(spark, sf_dir), _pieces(spark, sf_dir))
    return L.paths(edges, _connection(spark), 5).select("input", "rank", F.col("value").alias("surface"), "cost")




def _rules(spark: SparkSession, rows: list[list[str | None]]) -> DataFrame:
    """Rules of words; ``*`` is any word, ``pos:x`` a part of speech."""
    kind = lambda f: (X.KINDS["any"], "") if f == "*" else (X.KINDS["pos"], f[4:]) if f.startswith("pos:") else (X.KINDS["word"], f)
    return spark.createDataFrame([([kind(f) for f in r], "rules", i + 1) for i, r in enumerate(rows)], N.RULE)


@query(f"""{_PATHS}, pool AS (SELECT *, contains('/' || surface, '/bo/lt/') OR contains('/' || surface, '/ge/ar/') OR contains('/' || surface, '/r/od/') AS matched FROM ranked WHERE rank <= 32),
    cut AS (SELECT *, least(32, greatest(3, coalesce(min(rank) FILTER (matched) OVER (PARTITION BY input), 32))) AS c FROM pool),
    placed AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY matched DESC, rank) AS place FROM cut WHERE rank <= c)
    SELECT input, CAST(place AS INTEGER) AS place, surface, cost, matched FROM placed WHERE place <= 3""")
def ngram_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, [["bo/", "lt/"], ["ge/", "ar/"], ["r/", "od/"]])
    out = L.convert(_names(spark, sf_dir), _pieces(spark, sf_dir), _connection(spark), 3, rules)
    return out.select("input", "place", F.col("value").alias("surface"), "cost", "matched")


# Numbers as inputs, which grow with the tables: the last digits of the customers' keys; every piece of up to three digits has two surfaces.


def _digits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inputs = _t(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("input"))
    at = inputs.distinct().select("input", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select("input", "i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    keys = at.where("i + n <= 6").select(F.expr("substring(input, i, n)").alias("yomi")).distinct()
    words = keys.select("yomi", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("h"))
    number = F.col("yomi").cast("int") + F.when(F.col("h") == "a", 0).otherwise(3)
    return inputs, words.select(
        "yomi", (number % 7 + 1).cast("smallint").alias("left_id"), (number % 5 + 1).cast("smallint").alias("right_id"), (20 + (number * 7 + F.length("yomi") * 11) % 50).cast("smallint").alias("cost"),
        F.concat("yomi", "h").alias("tango"), F.lit("digits").alias("src"), F.lit(0).cast("bigint").alias("ord"))


@query("""WITH RECURSIVE names AS (SELECT DISTINCT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS input FROM customer),
    k AS (SELECT DISTINCT substr(input, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS yomi FROM names, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 4)) AS n) WHERE i + n <= 6),
    v AS (SELECT yomi, yomi || h AS tango, CAST(yomi AS INTEGER) + CASE h WHEN 'a' THEN 0 ELSE 3 END AS x FROM k, (SELECT unnest(['a', 'b']) AS h)),
    dict AS (SELECT yomi, tango, x % 7 + 1 AS l, x % 5 + 1 AS r, 20 + (x * 7 + length(yomi) * 11) % 50 AS w FROM v),
    spots AS (SELECT input, s, n, substr(input, CAST(s + 1 AS INTEGER), CAST(n AS INTEGER)) AS yomi FROM names, (SELECT unnest(range(0, 5)) AS s), (SELECT unnest(range(1, 4)) AS n) WHERE s + n <= 5),
    edges AS (SELECT input, s, s + n AS e, tango, l, r, w FROM spots JOIN dict USING (yomi)),
    p AS (SELECT input, e, r, w + (l * 3) % 11 AS cost, tango AS surface FROM edges WHERE s = 0
          UNION ALL SELECT p.input, d.e, d.r, p.cost + d.w + (p.r * 7 + d.l * 3) % 11, p.surface || d.tango FROM p JOIN edges d ON p.input = d.input AND p.e = d.s),
    done AS (SELECT input, surface, min(cost + (r * 7) % 11) AS cost FROM p WHERE e = 5 GROUP BY ALL),
    ranked AS (SELECT input, surface, CAST(cost AS INTEGER) AS cost, CAST(row_number() OVER (PARTITION BY input ORDER BY cost, surface) AS INTEGER) AS rank FROM done)
    SELECT input, rank, surface, cost FROM ranked WHERE rank <= 3""")
def convert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best conversions of every number."""
    inputs, words = _digits(spark, sf_dir)
    return L.convert(inputs, words, _connection(spark), 3).select("input", "rank", F.col("value").alias("surface"), "cost")


# --- matrices and rules ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT event_type AS name FROM events), ids AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id FROM t),
    prev AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events),
    n AS (SELECT a, b, count(*) AS n FROM prev WHERE a IS NOT NULL GROUP BY ALL)
    SELECT x.id AS "left", y.id AS "right", coalesce(n, 0) AS n FROM ids x CROSS JOIN ids y LEFT JOIN n ON n.a = x.name AND n.b = y.name""")
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition counts between event types as a dense grid."""
    from pyspark.sql import Window as W

    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    ids = D.string_pool(events, "event_type")
    prev = events.select(F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("a"), F.col("event_type").alias("b")).where("a IS NOT NULL")
    n = prev.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = ids.agg(F.array_sort(F.collect_list(F.struct("value", "id"))).alias("x"))  # the handful of types
    cells = grid.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q"))
    return cells.select(F.col("p.value").alias("a"), F.col("q.value").alias("b"), F.col("p.id").cast("int").alias("left"), F.col("q.id").cast("int").alias("right")).join(n, ["a", "b"], "left").select("left", "right", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_EVENT_RULES = [["view", "click"], ["click", "*", "purchase"], ["error", "pos:s", "error"], ["signup", "view", "view", "view"], ["pos:p", "*", "*", "*", "signup"], ["error"]]


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS w0, lead(event_type, 1) OVER u AS w1, lead(event_type, 2) OVER u AS w2, lead(event_type, 3) OVER u AS w3, lead(event_type, 4) OVER u AS w4
    FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, ts, rule FROM (
      SELECT user_id, ts, 'W:view|W:click' AS rule FROM e WHERE w0 = 'view' AND w1 = 'click'
      UNION ALL SELECT user_id, ts, 'W:click|*|W:purchase' FROM e WHERE w0 = 'click' AND w2 = 'purchase'
      UNION ALL SELECT user_id, ts, 'W:error|P:s|W:error' FROM e WHERE w0 = 'error' AND left(w1, 1) = 's' AND w2 = 'error'
      UNION ALL SELECT user_id, ts, 'W:signup|W:view|W:view|W:view' FROM e WHERE w0 = 'signup' AND w1 = 'view' AND w2 = 'view' AND w3 = 'view'
      UNION ALL SELECT user_id, ts, 'P:p|*|*|*|W:signup' FROM e WHERE left(w0, 1) = 'p' AND w4 = 'signup'
      UNION ALL SELECT user_id, ts, 'W:error' FROM e WHERE w0 = 'error')""")
def ngram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("word"), F.substring("event_type", 1, 1).alias("pos"))
    return N.matching_windows(events, _rules(spark, _EVENT_RULES), ["user_id"], "ts", "word", "pos")


@query("""WITH e AS (SELECT user_id, ts, event_type AS w0, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS w1 FROM events)
    SELECT user_id, ts FROM e WHERE (w0 = 'view' AND w1 = 'click') OR (w0 = 'click' AND w1 IS NOT NULL) OR (w0 = 'error' AND left(w1, 1) = 's') OR (w0 = 'signup' AND w1 = 'view') OR (left(w0, 1) = 'p' AND w1 IS NOT NULL) OR w0 = 'error'""")
def ngram_may_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where the first two features of a rule match."""
    events = _t(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("word"), F.substring("event_type", 1, 1).alias("pos"))
    return N.may_begin(events, _rules(spark, _EVENT_RULES), ["user_id"], "ts", "word", "pos")


# --- dictionaries ---------------------------------------------------------------------------------------------

_EXCLUDED = [("red gizmo", None, None), ("blue bolt", "Brand#4", None), ("hot ring", None, "PROMO"), ("cold rod", "Brand#7", "SMALL"), ("new gear", "Brand#99", None)]


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part p WHERE NOT EXISTS (
    SELECT 1 FROM (VALUES ('red gizmo', NULL, NULL), ('blue bolt', 'Brand#4', NULL), ('hot ring', NULL, 'PROMO'), ('cold rod', 'Brand#7', 'SMALL'), ('new gear', 'Brand#99', NULL)) r(n, b, t)
    WHERE n = p_name AND (b IS NULL OR b = p_brand) AND (t IS NULL OR t = p_type))""")
def rule_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_EXCLUDED, "p_name string, p_brand string, p_type string")
    return D.without_rules(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), rules, "p_name", ["p_brand", "p_type"])


@query("""SELECT s_suppkey AS id, s_nationkey AS nation, s_suppkey % 10 AS digit FROM supplier
    UNION ALL SELECT c_custkey, c_nationkey, c_custkey % 10 FROM customer WHERE (c_nationkey, c_custkey % 10) NOT IN (SELECT (s_nationkey, s_suppkey % 10) FROM supplier)""")
def missing_pair_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, then the customers of which the pair of nation and last digit is not among theirs."""
    base = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("digit"))
    more = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("digit"))
    return D.union_ranked(base, D.missing(more, base, ["nation", "digit"])).drop("src_rank")


@query("""SELECT p_type, string_agg(p_name, ',' ORDER BY length(p_name), p_name) AS names FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY p_type""")
def group_by_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_type", "p_name").distinct().withColumn("n", X.utf16_length(F.col("p_name")))
    return D.group_ordered(rows, "p_type", ["p_name"], ["n", "p_name"]).select("p_type", F.array_join(F.transform("entries", lambda e: e["p_name"]), ",").alias("names"))


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, CAST(row_number() OVER (ORDER BY first DESC, l_returnflag, l_linestatus) - 1 AS INTEGER) AS id FROM f""")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return D.first_seen_ids(rows, ["l_returnflag", "l_linestatus"], "ord")


@query("""WITH f AS (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority, o_orderstatus, CAST(row_number() OVER (ORDER BY first DESC, o_orderpriority, o_orderstatus) - 1 AS INTEGER) AS id, n FROM f""")
def pair_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows encoded by the dense ids of their pairs."""
    keys = ["o_orderpriority", "o_orderstatus"]
    rows = _t(spark, sf_dir, "orders").select(*keys, F.col("o_orderkey").alias("ord"))
    return D.encoded(rows, D.first_seen_ids(rows, keys, "ord"), keys).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1""")
def cheapest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice", F.lower("p_type").alias("low"))
    return D.cheapest(rows, ["p_brand", "low"], "p_retailprice", ["p_partkey"]).drop("low")


@query("""WITH v AS (SELECT n_name AS value FROM nation UNION SELECT r_name FROM region) SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM v""")
def string_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("v")).union(_t(spark, sf_dir, "region").select("r_name"))
    return D.string_pool(names, "v").select("value", F.col("id").cast("long").alias("id"))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT p_name AS value FROM part)),
    b AS (SELECT *, id // 16 AS block, lag(value) OVER (PARTITION BY id // 16 ORDER BY id) AS prev FROM v)
    SELECT id, value, block, CAST(coalesce((SELECT max(k) FROM (SELECT unnest(range(1, 60)) AS k) WHERE k <= least(length(value), length(prev)) AND left(value, CAST(k AS INTEGER)) = left(prev, CAST(k AS INTEGER))), 0) AS INTEGER) AS shared FROM b""")
def front_code_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.front_coded(_t(spark, sf_dir, "part"), "p_name").select(F.col("id").cast("long").alias("id"), "value", F.col("block").cast("long").alias("block"), "shared")


@query("""WITH per AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
    SELECT (SELECT count(*) FROM per) AS readings, (SELECT count(*) FROM per WHERE n = 1) AS single, (SELECT count(*) FROM per WHERE n > 1) AS multiple, (SELECT max(n) FROM per) AS largest,
      count(*) AS entries, count(DISTINCT p_name) AS surfaces, count(DISTINCT p_type || '|' || p_name) AS pairs, min(length(p_type)) AS min_length, max(length(p_type)) AS max_length, CAST(min(p_size) AS BIGINT) AS min_cost, CAST(max(p_size) AS BIGINT) AS max_cost FROM part""")
def dictionary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(_t(spark, sf_dir, "part").select(F.col("p_type").alias("yomi"), F.col("p_name").alias("tango"), F.col("p_size").alias("cost")))


# --- suggestions ----------------------------------------------------------------------------------------------
# Four ranked sources: parts by brand, type, name and size, and brands' types as custom entries. Keys get a sign in front, as only rules may be ASCII.


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    source = lambda key, value, kind: p.select(key.alias("key"), value.alias("value"), F.lit(kind).cast("smallint").alias("type"), F.col("p_partkey").alias("ord"))
    sign = lambda c: F.concat(F.lit("語"), c)
    return Z.merged(
        source(F.col("p_brand"), F.col("p_name"), 0), source(F.when(F.col("p_size") % 2 == 0, sign("p_name")).otherwise(F.col("p_name")), F.col("p_brand"), 3),
        source(sign("p_type"), F.col("p_name"), 2), source(sign(F.concat("p_brand", "p_type", "p_name")), F.col("p_type"), 0), source(sign("p_type"), F.col("p_name"), 0))


_MERGED = """WITH s AS (
      SELECT p_brand AS key, p_name AS value, 0 AS type, p_partkey AS ord, 0 AS src_rank FROM part
      UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN '語' || p_name ELSE p_name END, p_brand, 3, p_partkey, 1 FROM part
      UNION ALL SELECT '語' || p_type, p_name, 2, p_partkey, 2 FROM part
      UNION ALL SELECT '語' || p_brand || p_type || p_name, p_type, 0, p_partkey, 3 FROM part
      UNION ALL SELECT '語' || p_type, p_name, 0, p_partkey, 4 FROM part),
    f AS (SELECT *, count(*) OVER (PARTITION BY src_rank, key) AS n, row_number() OVER (PARTITION BY src_rank, key ORDER BY ord) AS k FROM s WHERE src_rank IN (0, 4) OR key[1] = '語'),
    kept AS (SELECT * FROM f WHERE src_rank IN (0, 4) OR (src_rank IN (1, 3) AND n <= 3) OR (src_rank = 2 AND k <= 3)),
    d AS (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY src_rank, ord) AS seen FROM kept),
    m AS (SELECT key, value, CAST(type AS SMALLINT) AS type, CAST(src_rank AS INTEGER) AS src_rank, CAST(row_number() OVER (PARTITION BY key ORDER BY src_rank, ord) AS INTEGER) AS place FROM d WHERE src_rank < 4 OR seen = 1)"""


@query(f"{_MERGED} SELECT key, value, type, src_rank, place FROM m")
def zero_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir).drop("ord")


@query(f"""{_MERGED}, pool AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT key AS v FROM m UNION SELECT value FROM m))
    SELECT key, place, value, type, a.id AS key_id, b.id AS value_id FROM m JOIN pool a ON a.v = m.key JOIN pool b ON b.v = m.value WHERE key IN ('語PROMO', '語SMALL', 'Brand#3', 'none')""")
def zero_query_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _suggestions(spark, sf_dir)
    asked = spark.createDataFrame([("語PROMO",), ("語SMALL",), ("Brand#3",), ("none",)], "key string")
    pool = D.string_pool(entries, "key", "value").withColumn("id", F.col("id").cast("long"))
    found = Z.lookup(entries, asked)
    return found.join(pool.select(F.col("value").alias("key"), F.col("id").alias("key_id")), "key").join(pool.select("value", F.col("id").alias("value_id")), "value")


@query(f"""{_MERGED}, pool AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT key AS v FROM m UNION SELECT value FROM m))
    SELECT a.id AS key_id, b.id AS value_id, type, place FROM m JOIN pool a ON a.v = m.key JOIN pool b ON b.v = m.value""")
def zero_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.tokens(_suggestions(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("key_id", "value_id")})


# --- scalar functions -----------------------------------------------------------------------------------------

_KINDS = "(VALUES (1, 1, 0, 0, 0, 0), (2, 1, 1, 0, 0, 0), (3, 1, 3, 2, 0, 0), (4, 2, 2, 2, 2, 0), (5, 3, 1, 3, 1, 3))"


@query(f"SELECT CAST(n AS INTEGER) AS n, CAST(n | (a << 3) | (b << 5) | (c << 7) | (d << 9) | (e << 11) AS INTEGER) AS signature FROM {_KINDS} k(n, a, b, c, d, e)")
def signature_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([([1],), ([1, 1],), ([1, 3, 2],), ([2, 2, 2, 2],), ([3, 1, 3, 1, 3],)], "kinds array<int>")
    sig = rows.select(X.signature(F.col("kinds")).alias("signature")).distinct()
    return sig.select(X.signature_order(F.col("signature")).alias("n"), "signature")


@query(f"""SELECT id, text, translate(text, '{X._HIRA_RUN}', '{X._KATA_RUN}') AS katakana, CAST(length(text) AS INTEGER) AS units FROM (
    SELECT CAST(doc_id AS BIGINT) AS id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'ひらがなヴゔー'), (-2, 'ぁんがっこう'), (-3, '漢字とかな')))""")
def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, "ひらがなヴゔー"), (-2, "ぁんがっこう"), (-3, "漢字とかな")], "id long, text string")
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(more)
    return rows.select("id", "text", X.hira_to_kata(F.col("text")).alias("katakana"), X.utf16_length(F.col("text")).alias("units"))


# --- quality --------------------------------------------------------------------------------------------------


def _loanwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document as a surface; the digits of the document's id, as kana, are its reading."""
    docs = _spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "tango"))
    return docs.select(
        F.translate(F.col("doc_id").cast("string"), "0123456789", _DIGITS).alias("yomi"), "tango", (F.col("doc_id") % 300 + 1).cast("smallint").alias("cost"),
        (F.col("doc_id") * (1 << 20) + F.col("i")).alias("ord"))


_DIGITS = "あいうえおーかきくゕ"


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BLANK = r"\s\x1C-\x1F\p{Z}"
_ASSESSED = f"""WITH raw AS (SELECT translate(CAST(doc_id AS VARCHAR), '0123456789', '{_DIGITS}') AS yomi, tango, doc_id % 300 + 1 AS cost, doc_id * {1 << 20} + i AS ord FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS tango, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
    b AS (SELECT *, translate(yomi, 'ゕゖ', 'かけ') AS reading, regexp_replace(regexp_replace(tango, '^[{_BLANK}]+', ''), '[{_BLANK}]+$', '') AS s FROM raw),
    c AS (SELECT *, regexp_matches(reading, '^(?:[あぁ][あぁー]+|[いぃ][いぃー]+|[うぅ][うぅー]+|[えぇ][えぇー]+|[おぉ][おぉー]+)$') AS vocal, lower(s) AS low FROM b),
    f AS (SELECT *, list_filter([
      CASE WHEN reading <> yomi THEN 'reading-normalized' END, CASE WHEN s <> tango THEN 'surface-normalized' END, CASE WHEN regexp_matches(yomi, '[ゝゞ]') OR yomi = 'ー' THEN 'special-reading' END,
      CASE WHEN vocal THEN 'vocalization-reading' END, CASE WHEN length(reading) = 1 THEN 'single-character-reading' END,
      CASE WHEN regexp_matches(s, '^[^\\p{{L}}\\p{{Nd}}{_BLANK}]+$') THEN 'punctuation-only' END, CASE WHEN regexp_matches(s, '[!?！？]') THEN 'exclamatory-surface' END,
      CASE WHEN regexp_matches(s, '^[A-Za-z]$') THEN 'single-letter-surface' END,
      CASE WHEN low IN ({_sql_list(Q.NUMERIC_WORDS)}) OR regexp_matches(low, '^[0-9]+(?:st|nd|rd|th)?$') OR (regexp_matches(low, '\\p{{Nd}}') AND regexp_matches(low, '^[\\p{{Nd}}^+\\-*/=.]+$')) THEN 'numeric-surface' END,
      CASE WHEN s = low AND s IN ({_sql_list(Q.FUNCTION_WORDS)}) THEN 'function-word-surface' END,
      CASE WHEN low IN ({_sql_list(Q.INTERJECTIONS)}) OR (low IN ({_sql_list(Q.SHORT_RESPONSES)}) AND (length(reading) <= 2 OR vocal)) THEN 'interjection-surface' END,
      CASE WHEN regexp_matches(s, '^[{Q.HYPHENS}]|[{Q.HYPHENS}]$') THEN 'bound-morpheme' END, CASE WHEN contains(s, '...') OR contains(s, '…') THEN 'incomplete-placeholder' END,
      CASE WHEN regexp_matches(s, {_sql_text(Q.GLOSS)}) THEN 'explanatory-gloss' END,
      CASE WHEN length(s) - length(replace(s, ' ', '')) + 1 >= 8 OR length(s) >= 64 OR (length(s) >= 45 AND regexp_matches(s, '^\\p{{Ll}}')) THEN 'long-definition' END,
      CASE WHEN regexp_matches(s, {_sql_text(Q.FRAGMENT)}) THEN 'definition-fragment' END, CASE WHEN regexp_matches(tango, '[()]') THEN 'parenthetical' END], lambda x: x IS NOT NULL) AS flags FROM c),
    a AS (SELECT *, CASE WHEN len(list_filter(flags, lambda x: x NOT IN ('reading-normalized', 'surface-normalized', 'explanatory-gloss', 'long-definition', 'definition-fragment', 'parenthetical'))) > 0 OR regexp_matches(s, '[()]') THEN 'EXCLUDED'
      WHEN (regexp_matches(s, '[{_BLANK}{Q.HYPHENS}]')) OR len(list_filter(flags, lambda x: x IN ('explanatory-gloss', 'long-definition', 'definition-fragment'))) > 0 THEN 'REVIEW' ELSE 'PRIMARY' END AS status FROM f)"""


@query(f"""{_ASSESSED} SELECT ord, status, CAST(CASE status WHEN 'PRIMARY' THEN 100 WHEN 'EXCLUDED' THEN 0 ELSE greatest(40, 100 - 20 * len(list_filter(flags, lambda x: x IN ('explanatory-gloss', 'long-definition', 'definition-fragment')))) END AS INTEGER) AS score,
    array_to_string(flags, ',') AS flags, CAST(CASE WHEN status = 'PRIMARY' THEN cost END AS INTEGER) AS runtime_cost FROM a""")
def quality_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.assessed(_loanwords(spark, sf_dir)).select("ord", "status", "score", F.array_join("flags", ",").alias("flags"), "runtime_cost")


@query(f"""{_ASSESSED}, r AS (SELECT *, row_number() OVER (PARTITION BY reading, low ORDER BY cost, ord) AS k FROM a WHERE status = 'PRIMARY')
    SELECT count(*) AS raw_entries, count(*) FILTER (status = 'PRIMARY') AS primary_entries, count(*) FILTER (status = 'REVIEW') AS review_entries, count(*) FILTER (status = 'EXCLUDED') AS excluded_entries,
    count(DISTINCT yomi) AS raw_readings, (SELECT count(*) FROM r WHERE k = 1) AS runtime_entries, (SELECT count(DISTINCT reading) FROM r WHERE k = 1) AS runtime_readings FROM a""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summary(Q.assessed(_loanwords(spark, sf_dir)))


@query(f"{_ASSESSED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM a) GROUP BY flag")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flag_counts(Q.assessed(_loanwords(spark, sf_dir)))


_DESCRIBED = f"""{_ASSESSED}, e AS (SELECT *, lower(status) AS low_status, CASE WHEN len(flags) = 0 THEN '-' ELSE array_to_string(flags, ',') END AS flag_text, CASE WHEN status = 'PRIMARY' THEN cost END AS runtime_cost,
      CASE status WHEN 'PRIMARY' THEN 100 WHEN 'EXCLUDED' THEN 0 ELSE greatest(40, 100 - 20 * len(list_filter(flags, lambda x: x IN ('explanatory-gloss', 'long-definition', 'definition-fragment')))) END AS score FROM a)"""


@query(f"""{_DESCRIBED}, t AS (SELECT *, tango || ' [cost=' || cost || '; status=' || low_status || '; score=' || score || '; flags=' || flag_text
      || CASE WHEN s <> tango THEN '; runtime_surface=' || s ELSE '' END || CASE WHEN runtime_cost IS NOT NULL THEN '; runtime_cost=' || runtime_cost ELSE '' END || ']' AS said FROM e)
    SELECT yomi AS reading, min(reading) AS normalized_reading, CAST(count(*) AS INTEGER) AS candidate_count,
      {", ".join(f"CAST(count(*) FILTER (low_status = '{x}') AS INTEGER) AS {x}_count, coalesce(string_agg(said, ' | ' ORDER BY coalesce(runtime_cost, 2147483647), tango, ord) FILTER (low_status = '{x}'), '') AS {x}_candidates" for x in ("primary", "review", "excluded"))}
    FROM t GROUP BY yomi""")
def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.candidate_report(Q.assessed(_loanwords(spark, sf_dir)))


@query(f"""{_DESCRIBED} SELECT row_number() OVER (ORDER BY ord) AS entry_index, yomi AS reading, reading AS normalized_reading, tango AS english_candidate, s AS normalized_surface,
    CAST(cost AS SMALLINT) AS source_cost, CAST(runtime_cost AS INTEGER) AS runtime_cost, low_status AS status, CAST(score AS INTEGER) AS score, flag_text AS flags FROM e""")
def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the quality report for each entry."""
    return Q.quality_rows(Q.assessed(_loanwords(spark, sf_dir)))


@query(f"{_ASSESSED}, r AS (SELECT *, row_number() OVER (PARTITION BY reading, low ORDER BY cost, ord) AS k FROM a WHERE status = 'PRIMARY') SELECT reading AS yomi, s AS tango, CAST(cost AS SMALLINT) AS cost, ord FROM r WHERE k = 1")
def runtime_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.runtime_rows(Q.assessed(_loanwords(spark, sf_dir))).select("yomi", "tango", "cost", "ord")


# --- validation -----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""")
def fk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order, and documents without a label."""
    customers = V.orphans(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), _t(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"})
    return customers.unionByName(V.orphans(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), F.col("lang").alias("c_name")), _t(spark, sf_dir, "labels"), {"c_custkey": "doc_id"}))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS left_id, l_suppkey AS right_id FROM lineitem WHERE l_partkey NOT BETWEEN 0 AND 89 OR l_suppkey NOT BETWEEN 0 AND 89")
def id_range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id outside a range."""
    return V.bad_ids(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id")), 90)


@query("""SELECT c.name, CAST(row_number() OVER (ORDER BY c.name) AS INTEGER) AS id FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part) c""")
def coarse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of the part names' first words."""
    return N.coarse_classes(_t(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("name")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT nation, side, count(*) AS n FROM (
    SELECT *, 'missing' AS side FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT *, 'unexpected' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) GROUP BY ALL""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return V.differences(a, b).groupBy("nation", "side").agg(F.count(F.lit(1)).alias("n"))
