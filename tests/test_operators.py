import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import dictionary as D
from glyphmill.operators import lattice as L
from glyphmill.operators import ngram as N
from glyphmill.operators import quality as Q
from glyphmill.operators import validate as V
from glyphmill.operators import zeroquery as Z

DICT = "yomi string, left_id smallint, right_id smallint, cost smallint, tango string, ord bigint"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "がっこうゔー漢", X.hira_to_kata) == "ガッコウゔー漢"
    assert one(spark, "が", X.is_hiragana) and not one(spark, "", X.is_hiragana) and one(spark, "ー", X.is_katakana)
    assert one(spark, "😀あ", X.utf16_length) == 3
    assert one(spark, "ＡＢ~", X.nfkc_reading) == "AB〜"
    assert one(spark, "笑顔12", X.remove_trailing_number) == "笑顔" and one(spark, "12", X.remove_trailing_number) == "12"
    assert one(spark, "　a b\t", X.trim_blank) == "a b"
    assert one(spark, " a" + " " * 300_000 + "b ", lambda c: F.length(X.trim_blank(c))) == 300_002
    assert one(spark, "a\t\tb", lambda c: X.split_keeping_empty(c, "\t")) == ["a", "", "b"]
    assert one(spark, "", lambda c: X.hash64(F.encode(c, "UTF-8"))) is not None
    kinds = spark.createDataFrame([([1, 3, 2],)], "k array<int>").select(X.signature(F.col("k")).alias("s"))
    assert kinds.first()[0] == 3 | 1 << 3 | 3 << 5 | 2 << 7


def grid(spark, cost):
    n = len(cost)
    return spark.createDataFrame([(i, j, cost[i][j]) for i in range(n) for j in range(n)], "left int, right int, cost smallint")


def test_cost_direction(spark):
    """The cost is looked up by the right id before and the left id after."""
    words = spark.createDataFrame([("x", 1, 1, 0, "A", 0), ("x", 2, 2, 0, "B", 1)], DICT)
    matrix = grid(spark, [[0, 1, 100], [0, 0, 0], [0, 0, 0]])
    got = L.convert(spark.createDataFrame([("x",)], "input string"), words, matrix).first()
    assert (got.value, got.cost) == ("A", 1)


def test_paths_match_enumeration(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(12)]
    keys = ["a", "b", "ab", "bc", "ca", "abc", "aa", "b"]
    words = [(k, rng.randint(1, 3), rng.randint(1, 3), rng.randint(0, 9), f"{k}{i};", i) for i, k in enumerate(keys)]
    cost = [[rng.randint(0, 9) for _ in range(4)] for _ in range(4)]

    def all_paths(text):
        def go(at, r, c, s):
            if at == len(text):
                yield c + cost[r][0], s
            for k, le, ri, w, t, _ in words:
                if text.startswith(k, at):
                    yield from go(at + len(k), ri, c + w + cost[r][le], s + t)

        return sorted(go(0, 0, 0, ""))

    inputs, matrix, d = spark.createDataFrame([(t,) for t in texts], "input string"), grid(spark, cost), spark.createDataFrame(words, DICT)
    edges = L.prefix_edges(inputs, d)
    many = {}
    for r in L.paths(edges, matrix, 4).collect():
        many.setdefault(r.input, []).append((r.cost, r.value))
    best = {r.input: (r.cost, r.path) for r in L.paths(edges, matrix).collect()}
    for t in set(texts):
        want = all_paths(t)
        assert sorted(many.get(t, [])) == want[:4]
        assert best.get(t, (None,))[0] == (want[0][0] if want else None)
        if want:
            assert "".join(n["key"] for n in best[t][1]) == t and best[t][1][-1]["end"] == len(t)
    assert L.paths(edges, matrix, 0).count() == 0


def test_missing_connection_is_an_error(spark):
    d = spark.createDataFrame([("x", 7, 7, 0, "A", 0)], DICT)
    with pytest.raises(Exception, match="no connection cost"):
        L.convert(spark.createDataFrame([("x",)], "input string"), d, grid(spark, [[0]])).collect()


def test_kana_surface_is_its_reading(spark):
    d = spark.createDataFrame([("おっけー", 0, 0, 0, "オーケー", 0)], DICT)
    got = L.prefix_edges(spark.createDataFrame([("おっけー",)], "input string"), d, kana_surface="reading").first()
    assert got.tango == "オッケー"


def test_rule_promotes(spark):
    d = spark.createDataFrame([("ゆび", 1, 1, 10, "指", 0), ("の", 2, 2, 0, "の", 1), ("きせき", 1, 1, 10, "奇跡", 2), ("きせき", 1, 1, 20, "軌跡", 3)], DICT)
    rules = spark.createDataFrame([([(1, "指"), (3, ""), (1, "軌跡")], "t", 1), ([(2, "名詞"), (1, "鳥")], "t", 2)], N.RULE)
    pos = spark.createDataFrame([(0, "BOS/EOS,*"), (1, "名詞,一般"), (2, "助詞,*")], "id int, name string")
    inputs = spark.createDataFrame([("ゆびのきせき",)], "input string")
    matrix = grid(spark, [[0] * 3] * 3)
    plain = [r.value for r in L.convert(inputs, d, matrix, 2).orderBy("rank").collect()]
    ruled = [r.value for r in L.convert(inputs, d, matrix, 2, rules, pos).orderBy("place").collect()]
    assert plain == ["指の奇跡", "指の軌跡"] and ruled == ["指の軌跡", "指の奇跡"]


def test_rule_language(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.words").write_text('冷蔵庫\n@include "sub/b.words"\n家\n')
    (tmp_path / "sub/b.words").write_text("洗濯機\n家\n")
    (tmp_path / "x.ngram").write_text('# c\n"a+\\"b" + words("a.words")\npos("名詞") + * + "y"\n')
    got = sorted(r.rule for r in N.rules_from(spark, str(tmp_path)).select(X.canonical(F.col("features")).alias("rule")).collect())
    assert got == sorted(['W:a+"b|W:冷蔵庫', 'W:a+"b|W:洗濯機', 'W:a+"b|W:家', "P:名詞|*|W:y"])
    for bad in ('"a"', '"a" + "b', '"a" + score("b")', '"a" + "\\q"', '"" + "b"', '"a" + words("../x.words")', "+".join(['"a"'] * 6)):
        with pytest.raises(N.RuleError):
            N.parse_rule(bad, lambda n: "w")
    loop = {"a.words": '@include "b.words"', "b.words": '@include "a.words"'}
    with pytest.raises(N.RuleError, match="each other"):
        N.word_list("a.words", loop.__getitem__)
    assert N.build_report(N.rules_from(spark, str(tmp_path))).first().asDict()["order_3"] == 1


def test_dictionary_operators(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("b", "y", 3)], "k string, v string, ord int")
    ids = {r.k: r.id for r in D.first_seen_ids(rows, ["k"], "ord").collect()}
    assert ids == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="no id"):
        D.encoded(spark.createDataFrame([("z",)], "k string"), D.first_seen_ids(rows, ["k"], "ord"), ["k"]).collect()
    assert [e.v for e in D.group_ordered(rows, "k", ["v"], ["ord"]).where("k = 'b'").first().entries] == ["x", "y"]
    values = [(f"v{i:04d}",) for i in range(500)]
    assert [r.id for r in D.string_pool(spark.createDataFrame(values, "v string"), "v").orderBy("value").collect()] == list(range(500))
    assert D.summary(spark.createDataFrame([], "yomi string, tango string, cost int")).first().entries == 0


def test_suggestions_merge(spark):
    t = "key string, value string, type smallint, ord bigint"
    make = lambda *r: spark.createDataFrame([(k, v, 0, i) for i, (k, v) in enumerate(r)], t)
    got = Z.merged(make(("あ", "。"), ("ab", "r")), make(("あ", "😀"), ("ab", "e"), *[("い", str(i)) for i in range(4)]), make(*[("あ", f"({i})") for i in range(1, 6)]), make(("あ", "☀"), ("あ", "。")), make(("あ", "☀"), ("あ", "新"), ("う", "z")))
    by = {}
    for r in got.orderBy("key", "place").collect():
        by.setdefault(r.key, []).append(r.value)
    assert by == {"あ": ["。", "😀", "(1)", "(2)", "(3)", "☀", "。", "新"], "ab": ["r"], "う": ["z"]}


def test_quality(spark):
    rows = [("あーとぎゃらりー", "art gallery"), ("ぎゃらりー", "art gallery"), ("あー", "two"), ("おっけー", "okay"), ("お", "x"), ("きゃっと", "cat"), ("きゃっと", "Cat"), ("はい", "indeed"), ("てすと", "used to test"), ("せん", "1,000!"), ("ゕ", "the act of"), ("もの", "(thing)"), ("ぷれ", "pre-")]
    df = spark.createDataFrame([(y, t, 100 + i, i) for i, (y, t) in enumerate(rows)], "yomi string, tango string, cost smallint, ord bigint")
    got = {(r.yomi, r.tango): r for r in Q.assessed(df).collect()}
    assert got["あーとぎゃらりー", "art gallery"].status == "PRIMARY" and got["ぎゃらりー", "art gallery"].status == "REVIEW" and got["ぎゃらりー", "art gallery"].flags == []
    assert got["あー", "two"].flags == ["vocalization-reading", "numeric-surface"] and got["あー", "two"].score == 0
    assert got["おっけー", "okay"].status == "PRIMARY" and got["はい", "indeed"].status == "EXCLUDED"
    assert got["てすと", "used to test"].status == "REVIEW" and "explanatory-gloss" in got["てすと", "used to test"].flags
    assert got["ゕ", "the act of"].flags[0] == "reading-normalized"
    assert {r.tango for r in Q.runtime_rows(Q.assessed(df)).collect()} >= {"cat", "okay"} and all(r.tango != "Cat" for r in Q.runtime_rows(Q.assessed(df)).collect())
    assert "raw entries | 13" in Q.markdown_summary(Q.assessed(df))


def test_validation(spark):
    defs = spark.createDataFrame([(0, "BOS/EOS,*,*,*,*,*,*"), (1, "n"), (1, "m"), (3, "n")], "id int, name string")
    assert {(r.fault, r.value) for r in V.id_definitions(defs).collect()} == {("id twice", "1"), ("name twice", "n"), ("id missing", "2")}
    good = spark.createDataFrame([(0, "BOS/EOS,*,*,*,*,*,*"), (1, "n")], "id int, name string")
    rows = spark.createDataFrame([("x", 1, 2, 0, "A", 0)], DICT)
    V.startup(good, grid(spark, [[0, 0], [0, 0]]))
    with pytest.raises(V.ValidationError, match="out of range"):
        V.startup(good, grid(spark, [[0, 0], [0, 0]]), rows)


def test_streaming(spark, tmp_path):
    from glyphmill.streaming.convert import converted

    spark.createDataFrame([("xy",)], "input string").write.parquet(str(tmp_path / "in"))
    d = spark.createDataFrame([("x", 0, 0, 1, "A", 0), ("y", 0, 0, 1, "B", 1)], DICT)
    q = converted(spark.readStream.schema("input string").parquet(str(tmp_path / "in")), d, grid(spark, [[0]]), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["AB"]


def test_front_coding_and_order(spark):
    df = spark.createDataFrame([(x,) for x in ("abc", "abd", "b", "abd")], "v string")
    assert [(r.value, r.shared) for r in D.front_coded(df, "v").orderBy("id").collect()] == [("abc", 0), ("abd", 2), ("b", 0)]
    words = ["～", "😀", "あい", "う"]
    got = [r.yomi for r in D.by_length(spark.createDataFrame([(w,) for w in words], "yomi string")).collect()]
    assert got == sorted(words, key=lambda w: (len(w.encode("utf-16-be")), w.encode("utf-16-be")))
    assert list(itertools.islice(got, 1)) == ["う"]
