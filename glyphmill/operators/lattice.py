"""Word lattices: prefix joins, best and N-best paths, reranking.

Inputs are texts; a dictionary has (yomi, left_id, right_id, cost, tango, ord); a
connection table has (left, right, cost): the cost of a word with left id ``right`` after one
with right id ``left``.  Context 0 with cost 0 stands before and behind every input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .dictionary import checkpointed

NODE = "struct<key:string,value:string,lid:int,rid:int,wcost:int,cost:int,start:int,end:int>"


def prefix_edges(inputs: DataFrame, dictionary: DataFrame, on: str = "input", kana_surface: str = "text") -> DataFrame:
    """(input, s, e, key, tango, l, r, w, ord): the words that begin at each place of each distinct input.

    A prefix condition would pair every place with every key; instead each place gives its
    substrings of the key lengths in use, and an equi-join looks them up.
    """
    lengths = dictionary.agg(F.array_sort(F.collect_set(F.length("yomi"))).alias("lens"))
    texts = inputs.select(F.col(on).alias("input")).where("input <> ''").distinct()
    spots = (
        texts.join(F.broadcast(lengths))  # one row: the lengths of the keys
        .select("input", "lens", F.explode(F.sequence(F.lit(0), F.length("input") - 1)).alias("s"))
        .select("input", "s", F.explode(F.filter("lens", lambda n: n <= F.length("input") - F.col("s"))).alias("n"))
        .select("input", "s", (F.col("s") + F.col("n")).alias("e"), F.expr("substring(input, s + 1, n)").alias("yomi"))
    )
    word = F.col("tango")
    if kana_surface == "reading":
        word = X.decoded_surface(X.surface_kind(F.col("yomi"), word), F.col("yomi"), word)
    return spots.join(dictionary, "yomi").select(
        "input", "s", "e", F.col("yomi").alias("key"), word.alias("tango"), F.col("left_id").cast("int").alias("l"), F.col("right_id").cast("int").alias("r"), F.col("cost").cast("int").alias("w"), F.col("ord").cast("long").alias("ord"))


def adjacency(edges: DataFrame, connection: DataFrame) -> DataFrame:
    """(input, s, m, e, left_key, right_key, left, right, cost): neighbouring words with their connection cost."""
    a = edges.select("input", F.col("s"), F.col("e").alias("m"), F.col("key").alias("left_key"), F.col("r").alias("left"))
    b = edges.select("input", F.col("s").alias("m"), F.col("e"), F.col("key").alias("right_key"), F.col("l").alias("right"))
    return _with_cost(a.join(b, ["input", "m"]), connection)


#: Cells of a connection table up to which it is broadcast (about 30 bytes each).
MOST = 500_000


def _with_cost(pairs: DataFrame, connection: DataFrame) -> DataFrame:
    """Pairs with the cost of their ids; ids are skewed, so the ids in use are joined once, and brought back by a broadcast if they are few."""
    lack = F.raise_error(F.concat(F.lit("no connection cost: "), F.col("left").cast("string"), F.lit(","), F.col("right").cast("string"))).cast("int")
    cells = connection.select("left", "right", F.col("cost").cast("int").alias("cost"))
    if cells.count() > MOST:
        cells = checkpointed(cells.join(pairs.select("left", "right").distinct(), ["left", "right"], "left_semi"))
    side = F.broadcast(cells) if cells.count() <= MOST else cells
    return pairs.join(side, ["left", "right"], "left").withColumn("cost", F.coalesce("cost", lack))


def _grouped(edges: DataFrame, connection: DataFrame) -> DataFrame:
    """A row for each input: its edges by start and order, and the connection costs that it can need.

    The lattice is made once: what follows reads its checkpoint.
    """
    word = F.struct("s", "e", "ord", "key", "tango", "l", "r", "w")
    words = checkpointed(edges.groupBy("input").agg(F.array_sort(F.collect_list(word)).alias("words")))
    begin, end = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("left"))), F.array(F.struct(F.length("input").alias("m"), F.lit(0).alias("right")))
    ends = words.select("input", F.explode(F.array_union(begin, F.transform("words", lambda x: F.struct(x["e"].alias("m"), x["r"].alias("left"))))).alias("p")).select("input", "p.*")
    begins = words.select("input", F.explode(F.array_union(end, F.transform("words", lambda x: F.struct(x["s"].alias("m"), x["l"].alias("right"))))).alias("p")).select("input", "p.*")
    pairs = _with_cost(ends.join(begins, ["input", "m"]).select("input", "left", "right").distinct(), connection)
    costs = pairs.groupBy("input").agg(F.collect_list(F.struct("left", "right", "cost")).alias("costs"))
    return words.join(costs, "input")


def _clamp(n: int) -> int:
    return max(X.INT_MIN, min(X.INT_MAX, n))


def _nodes(path: list[tuple]) -> list[dict]:
    return [{"key": w["key"], "value": w["tango"], "lid": w["l"], "rid": w["r"], "wcost": w["w"], "cost": c, "start": w["s"], "end": w["e"]} for w, c in path]


def _best(size: int, words: list[dict], cost: dict) -> list[tuple[int, list[tuple]]]:
    """The cheapest path; of equal ones that whose predecessors stand first (by start, then order)."""
    at: list[list[tuple]] = [[] for _ in range(size + 1)]  # by end: (total, word, previous)
    at[0].append((0, None, None))
    for w in sorted(words, key=lambda w: (w["s"], w["e"], w["ord"])):
        best = None
        for state in at[w["s"]]:
            total = _clamp(state[0] + w["w"] + cost[state[1]["r"] if state[1] else 0, w["l"]])
            if best is None or total < best[0]:
                best = (total, w, state)
        if best:
            at[w["e"]].append(best)
    best = None
    for state in at[size]:
        total = _clamp(state[0] + cost[state[1]["r"] if state[1] else 0, 0])
        if best is None or total < best[0]:
            best = (total, state)
    if best is None:
        return []
    path, state = [], best[1]
    while state[1]:
        path.append((state[1], state[0]))
        state = state[2]
    return [(best[0], path[::-1])]


def _many(size: int, words: list[dict], cost: dict, n: int) -> list[tuple[int, list[tuple]]]:
    """The cheapest paths of the n cheapest different surfaces, by (cost, surface).

    A state is (end, right id): what may follow costs the same from all its paths, so of each the n
    cheapest different surfaces are enough.
    """
    at: list[dict[int, dict[str, tuple]]] = [{} for _ in range(size + 1)]
    at[0][0] = {"": (0, ())}
    last = -1

    def prune(state: dict[str, tuple]) -> dict[str, tuple]:
        return dict(sorted(state.items(), key=lambda x: (x[1][0], x[0]))[:n])

    for w in sorted(words, key=lambda w: (w["s"], w["e"], w["ord"])):
        if w["s"] != last:
            last = w["s"]
            at[last] = {r: prune(s) for r, s in at[last].items()}
        for r, state in at[w["s"]].items():
            step = w["w"] + cost[r, w["l"]]
            goal = at[w["e"]].setdefault(w["r"], {})
            for surface, (total, path) in state.items():
                new, text = _clamp(total + step), surface + w["tango"]
                if text not in goal or new < goal[text][0]:
                    goal[text] = (new, (*path, (w, new)))
    done: dict[str, tuple] = {}
    for r, state in at[size].items():
        for surface, (total, path) in state.items():
            new = _clamp(total + cost[r, 0])
            if surface not in done or new < done[surface][0]:
                done[surface] = (new, path)
    return [(c, list(p)) for _, (c, p) in sorted(done.items(), key=lambda x: (x[1][0], x[0]))[:n]]


def paths(edges: DataFrame, connection: DataFrame, n: int = 1) -> DataFrame:
    """(input, rank from 1, value, cost, path) of the best path (n = 1) or the n best surfaces.

    An input that no words cover whole has no row. An input's lattice is one row; inputs are sentences.
    """
    schema = f"input string, rank int, value string, cost int, path array<{NODE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost = {(c["left"], c["right"]): c["cost"] for c in row["costs"]}
                size = len(row["input"])
                found = _best(size, row["words"], cost) if n == 1 else _many(size, row["words"], cost, n)
                out += [{"input": row["input"], "rank": i, "value": "".join(w["tango"] for w, _ in p), "cost": c, "path": _nodes(p)} for i, (c, p) in enumerate(found, 1)]
            yield pa.RecordBatch.from_pylist(out, to_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    from ..sources.text import schema as parsed

    to_arrow = to_arrow_schema(parsed(schema))
    if n <= 0:
        return edges.sparkSession.createDataFrame([], schema)
    return _grouped(edges, connection).mapInArrow(run, schema)


def pool_size(n: int, rules: bool) -> int:
    """Surfaces that are looked at before reranking."""
    return max(n, min(4 * n, 64), 32) if rules else n


def reranked(ranked: DataFrame, matched: DataFrame, n: int) -> DataFrame:
    """The first n of each input, matched ones first, then by rank, of those ranks that a search would have seen.

    ``ranked`` has the paths of the pool by cost, ``matched`` the (input, rank) that a rule matches. The search stops at
    n surfaces once one is matched, else at the end of the pool; a match beyond that is not promoted.
    """
    w = W.partitionBy("input")
    both = ranked.join(matched.select("input", "rank", F.lit(True).alias("matched")), ["input", "rank"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    cut = F.least(F.lit(pool_size(n, True)), F.greatest(F.lit(n), F.coalesce(F.min(F.when(F.col("matched"), F.col("rank"))).over(w), F.lit(pool_size(n, True)))))
    seen = both.withColumn("__cut", cut).where("rank <= __cut").drop("__cut")
    order = F.row_number().over(w.orderBy(F.desc("matched"), "rank"))
    return seen.withColumn("place", order).where(F.col("place") <= n)


def convert(inputs: DataFrame, dictionary: DataFrame, connection: DataFrame, n: int = 1, rules: DataFrame | None = None, pos: DataFrame | None = None, on: str = "input", kana_surface: str = "text") -> DataFrame:
    """Best (n = 1) or N-best conversions of the different inputs of a batch, reranked by n-gram rules if there are any.

    Repeated inputs have one answer, and one that no words cover whole has none; join back on the input for a row each.
    """
    from . import ngram

    edges = prefix_edges(inputs, dictionary, on, kana_surface)
    found = paths(edges, connection, pool_size(n, rules is not None))
    if rules is None:
        return found
    return reranked(found, ngram.matching_paths(found, rules, pos), n)
