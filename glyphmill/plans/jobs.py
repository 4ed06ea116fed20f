"""Batch jobs: ``python -m glyphmill.plans.jobs JOB --option value``; unknown and missing options are refused."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import lattice as L
from ..operators import ngram as N
from ..operators import quality as Q
from ..operators import validate as V
from ..operators import zeroquery as Z
from ..sources import binary as B
from ..sources import ngram_index as I
from ..sources import text as S


def validate(spark: SparkSession, id_def: str, connection: str, dictionaries: list[str]) -> None:
    """Id definitions, connection matrix and the ids of all dictionaries."""
    V.startup(S.id_definitions(spark, id_def), S.connection_matrix(spark, connection), *[S.dictionary(spark, d, "failfast") for d in dictionaries])


def build_dictionary(spark: SparkSession, base: list[str], output: str, additions: list[DataFrame] = (), missing: str | None = None, rules: DataFrame | None = None) -> DataFrame:
    """The dictionary as Parquet: base files without what ``rules`` exclude, additions in order, then the rows of ``missing`` of which the pair is new."""
    rows = S.dictionary(spark, base)
    if rules is not None:
        rows = D.without_rules(rows, rules, "yomi", [c for c in rules.columns if c != "yomi"])
    merged = D.union_ranked(rows, *additions)
    if missing:
        more = D.missing(S.dictionary(spark, missing), merged, ["yomi", "tango"])
        merged = merged.unionByName(more.withColumn("src_rank", F.lit(1 + len(additions))))
    D.write(merged, output)
    return spark.read.parquet(output)


def validate_english(spark: SparkSession, input: str, id_def: str | None = None) -> dict[str, int]:
    """Counts of a reading dictionary that is fit for use; with id definitions all its ids have to be the generic noun's."""
    context = S.generic_noun_id(S.id_definitions(spark, id_def)) if id_def else None
    return Q.check(S.english(spark, input, context))


def english_report(spark: SparkSession, input: str, output: str, summary: str, quality: str) -> None:
    """Candidates by reading and rows as tables, and the summary as Markdown."""
    rows = Q.assessed(S.english(spark, input))
    S.write_table(D.by_length(Q.candidate_report(rows), "reading"), output)
    S.write_table(Q.quality_rows(rows).orderBy("entry_index"), quality)
    B.write_file(spark, summary, Q.markdown_summary(rows, input).encode())


def compile_rules(spark: SparkSession, input: str, id_def: str, output: str, unigrams: bool = False) -> dict[str, int]:
    """Rule files into one packed index; its counts."""
    return I.write(N.rules_from(spark, input, unigrams), S.id_definitions(spark, id_def), output, 4 if unigrams else 3)


# The names of the suggestion files.
FILES = ("zero_query_token.data", "zero_query_string.data", "zero_query_number_token.data", "zero_query_number_string.data")
AUDIT = "zero_query_data.tsv"


def build_suggestions(spark: SparkSession, rules: str, numbers: str, emoji: str, emoticons: str, symbols: str, custom: str, output: str) -> dict[str, int]:
    """The merged suggestions and those after numbers as binary tables, and the merged ones as a table of text."""
    merged = Z.merged(
        S.zero_query_rules(spark, rules), S.zero_query_emoji(spark, emoji), S.zero_query_emoticons(spark, emoticons), S.zero_query_symbols(spark, symbols),
        S.zero_query_rules(spark, custom, custom=True))
    number = S.zero_query_numbers(spark, numbers).withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("ord")))
    a, b, c, d = (f"{output}/{f}" for f in FILES)
    n = {"entries": B.write_suggestions(merged, a, b), "number_entries": B.write_suggestions(number, c, d)}
    S.write_tsv(Z.audit(merged).select("key", "value"), f"{output}/{AUDIT}")
    return n


# Suggestions that a complete build has.
EXPECTED = (("@", "gmail.com"), ("ありがとう", "。"), ("服を", "着る"))
EXPECTED_NUMBERS = (("12", "月"), ("default", "年"))


def verify_suggestions(spark: SparkSession, directory: str, expected: tuple = EXPECTED, numbers: tuple = EXPECTED_NUMBERS) -> dict[str, int]:
    """Read both tables, look the expected suggestions up, and count the entries."""
    out = {}
    for name, files, wanted in (("entries", FILES[:2], expected), ("number_entries", FILES[2:], numbers)):
        entries = B.read_suggestions(spark, *(f"{directory}/{f}" for f in files))
        asked = spark.createDataFrame(list(wanted), "key string, value string")
        V.require_none(asked.join(Z.lookup(entries, asked), ["key", "value"], "left_anti"), f"suggestions that are missing in {files[0]}")
        out[name] = entries.count()
    return out


def write_matrix(spark: SparkSession, input: str, output: str) -> None:
    """A matrix of text as raw big-endian shorts; the file, of a few MB, is put together on the driver."""
    cells = S.connection_matrix(spark, input).orderBy("left", "right").select("cost")
    B.write_file(spark, output, B.matrix_bytes([r["cost"] for r in cells.toLocalIterator()]))


def convert(spark: SparkSession, inputs: str, dictionaries: list[str], connection: str, output: str, n: str = "1", rules: str | None = None, id_def: str | None = None) -> DataFrame:
    """Conversions of every line of the inputs as a table (path, line_no, input, rank, value, cost), in Parquet; a line that no words cover has no value.

    ``rules`` is a directory of rule files, by which the ``n`` best are reranked; parts of speech in them need the id definitions.
    """
    most = int(n)
    if most < 1:
        raise ValueError("n has to be 1 or more")
    lines = S.lines(spark, inputs).withColumnRenamed("value", "input")
    pos = S.id_definitions(spark, id_def) if id_def else None
    found = L.convert(lines, S.dictionary(spark, dictionaries), S.connection_matrix(spark, connection), most, N.rules_from(spark, rules) if rules else None, pos)
    place = "place" if rules else "rank"
    lines.join(found.select("input", F.col(place).alias("rank"), "value", "cost"), "input", "left").select("path", "line_no", "input", "rank", "value", "cost").write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


#: Options of each job: name, whether it is needed, and whether it takes many values or none.
JOBS = {
    "validate": (validate, {"id_def": "one", "connection": "one", "dictionaries": "many"}),
    "dictionary": (build_dictionary, {"base": "many", "output": "one", "missing": "maybe"}),
    "validate-english": (validate_english, {"input": "one", "id_def": "maybe"}),
    "english-report": (english_report, {"input": "one", "output": "one", "summary": "one", "quality": "one"}),
    "rules": (compile_rules, {"input": "one", "id_def": "one", "output": "one", "unigrams": "flag"}),
    "suggestions": (build_suggestions, {n: "one" for n in ("rules", "numbers", "emoji", "emoticons", "symbols", "custom", "output")}),
    "verify-suggestions": (verify_suggestions, {"directory": "one"}),
    "convert": (convert, {"inputs": "one", "dictionaries": "many", "connection": "one", "output": "one", "n": "maybe", "rules": "maybe", "id_def": "maybe"}),
    "matrix": (write_matrix, {"input": "one", "output": "one"}),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None):
    parser = argparse.ArgumentParser(prog="glyphmill", allow_abbrev=False)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (job, options) in JOBS.items():
        own = jobs.add_parser(name, help=job.__doc__, allow_abbrev=False)
        for option, kind in options.items():
            how = {"action": "store_true"} if kind == "flag" else {"nargs": "+"} if kind == "many" else {}
            own.add_argument("--" + option.replace("_", "-"), dest=option, **how, **({"required": True} if kind in ("one", "many") else {}))
    found = vars(parser.parse_args(args))
    job = JOBS[found.pop("job")][0]
    result = job(spark or SparkSession.builder.getOrCreate(), **{k: v for k, v in found.items() if v is not None})
    if isinstance(result, dict):
        print(*(f"{k}={v}" for k, v in result.items()), sep="\n")
    return result


if __name__ == "__main__":
    main()
