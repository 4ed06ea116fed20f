"""Checks that return the rows at fault; a clean table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: the name of id 0.
BEGIN = "BOS/EOS,*,*,*,*,*,*"


class ValidationError(ValueError):
    """A check found rows at fault."""


def require_none(faults: DataFrame, what: str) -> None:
    """Raise with the first few faults, if there are any."""
    if rows := faults.limit(5).collect():
        raise ValidationError(f"{what}: {[r.asDict() for r in rows]}")


def orphans(rows: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of which the keys (row column to parent column) are not in the parent; null keys are orphans."""
    p = parent.select(*[F.col(v).alias(f"__{v}") for v in on.values()]).distinct()
    cond = [F.col(k) == F.col(f"__{v}") for k, v in on.items()]
    return rows.join(p, cond, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_ids(rows: DataFrame, size: int) -> DataFrame:
    """Dictionary rows with a left or right id outside 0 to size - 1."""
    return rows.where(~F.col("left_id").between(0, size - 1) | ~F.col("right_id").between(0, size - 1))


def id_definitions(defs: DataFrame) -> DataFrame:
    """(fault, value): ids or names given twice, ids that are missing, and a wrong name of id 0."""
    n = defs.agg(F.max("id").alias("m"))
    whole = n.where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("id"))
    fault = lambda df, kind, value: df.select(F.lit(kind).alias("fault"), F.col(value).cast("string").alias("value"))
    begin = defs.where((F.col("id") == 0) & (F.col("name") != BEGIN))
    return (
        fault(repeated(defs, ["id"]), "id twice", "id").unionByName(fault(repeated(defs, ["name"]), "name twice", "name"))
        .unionByName(fault(whole.join(defs, "id", "left_anti"), "id missing", "id")).unionByName(fault(begin, "name of 0", "name"))
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in a (missing) or only in b (unexpected), each as often as it is there more."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def startup(defs: DataFrame, matrix: DataFrame, *dictionaries: DataFrame) -> None:
    """Id definitions, the matrix' size against them, and the ids of all dictionaries."""
    require_none(id_definitions(defs), "id definitions")
    size = defs.count()
    cells = matrix.agg(F.max("left"), F.max("right"), F.count(F.lit(1))).first()
    if tuple(cells) != (size - 1, size - 1, size * size):
        raise ValidationError(f"a connection matrix for {size} ids is needed; found {tuple(cells)}")
    for d in dictionaries:
        require_none(bad_ids(d, size), "ids out of range")
