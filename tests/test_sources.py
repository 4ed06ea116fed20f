import io
import struct
import zipfile

import pytest

from glyphmill.functions import text as X
from glyphmill.sources import binary as B
from glyphmill.sources import ngram_index as I
from glyphmill.sources import text as S


def put(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dictionary_modes(spark, tmp_path):
    p = put(tmp_path, "d.txt", "あ\t1\t2\t300\t亜\textra\nshort\t1\nう\t5\t1\t1\t鵜\r\n")
    assert rows(S.dictionary(spark, p, src="d"), "ord") == [("あ", 1, 2, 300, "亜\textra", "d", 1), ("う", 5, 1, 1, "鵜", "d", 3)]
    for bad in ("い\t99999\t2\t3\t井\n", "う\t 5\t1\t1\t鵜\n"):
        with pytest.raises(Exception, match="short number"):
            S.dictionary(spark, put(tmp_path, "bad.txt", bad)).collect()
    q = put(tmp_path, "c.txt", "え\t1\t1\t1\t絵\n")
    assert [r[0] for r in rows(S.dictionary(spark, [p, q, p]), "ord")] == ["あ", "う", "え", "あ", "う"]
    with pytest.raises(Exception, match="five fields"):
        S.dictionary(spark, p, "failfast").collect()


def test_lines_over_many_blocks(spark, tmp_path):
    texts = {f"{k}.txt": "".join(f"{k} line {i} {'x' * (i % 50)}\n" for i in range(3000)) for k in "ab"} | {"c.txt": "no break at the end", "d.txt": "", "e.txt": "\n\nlast\r\n"}
    for name, text in texts.items():
        put(tmp_path / "many", name, text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = S.lines(spark, str(tmp_path / "many"))
        got = {(r.path.rsplit("/", 1)[1], r.line_no): r.value for r in df.collect()}
        assert S.lines(spark, str(tmp_path / "many" / "a.txt")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(n, i): v for n, t in texts.items() for i, v in enumerate(t.replace("\r\n", "\n").removesuffix("\n").split("\n") if t else [], 1)}
    assert got == want


def test_zip(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in.txt", "か\t1\t2\t3\t蚊\n")
    p = put(tmp_path, "d.zip", data.getvalue())
    assert rows(S.zipped_dictionary(spark, p, "in.txt").select("yomi", "cost", "tango", "ord"), "ord") == [("か", 3, "蚊", 1)]
    with pytest.raises(Exception, match="other.txt"):
        S.zipped_dictionary(spark, p, "other.txt").collect()


def test_sign_tables(spark, tmp_path):
    p = put(tmp_path, "e.tsv", "😀\tえがお わらい\t\n(^^)\tにこ\n")
    assert [r[:1] + r[3:5] for r in rows(S.emoji(spark, p), "ord")] == [("えがお", 6000, "😀"), ("わらい", 6000, "😀"), ("", 6000, "😀"), ("にこ", 6000, "(^^)")]
    assert [r[0] for r in rows(S.emoticon(spark, p), "ord")] == ["えがお", "わらい", "にこ"]
    s = put(tmp_path, "s.tsv", "  ☆   ほし すたー\n\n")
    assert [(r[0], r[4]) for r in rows(S.symbol(spark, s), "ord")] == [("ほし", "☆"), ("すたー", "☆")]
    k = put(tmp_path, "k.tsv", "諺\tことわざ\nbad\n")
    assert [(r[0], r[4], r[3]) for r in rows(S.proverb(spark, k), "ord")] == [("ことわざ", "諺", 3000)]
    c = put(tmp_path, "c.tsv", "雰囲気\tふいんき\tふんいき\n")
    assert [(r[0], r[4]) for r in rows(S.reading_correction(spark, c), "ord")] == [("ふいんき", "雰囲気\tふんいき")]
    one = put(tmp_path, "o.tsv", "あ,亜\nあ\t阿唖\n")
    assert [(r[0], r[4]) for r in rows(S.single_kanji(spark, one), "ord")] == [("あ", "阿"), ("あ", "唖")]


def test_english_is_strict(spark, tmp_path):
    good = put(tmp_path, "g.txt", "# note\n\nあい\t1851\t1851\t10\teye\n")
    assert rows(S.english(spark, good, 1851).select("yomi", "cost", "tango", "ord"), "ord") == [("あい", 10, "eye", 3)]
    for i, bad in enumerate(["あい\t1\t1\t0\teye", "あい\t1\t1\t5", "あい\t1\tx\t5\teye", "あい\t1\t1\t5\t" + "e" * 257]):
        with pytest.raises(Exception):
            S.english(spark, put(tmp_path, f"b{i}.txt", bad)).collect()


def test_matrix(spark, tmp_path):
    p = put(tmp_path, "m.txt", "2\n1\n-2\n3\n4\n")
    assert rows(S.connection_matrix(spark, p), "left", "right") == [(0, 0, 1), (0, 1, -2), (1, 0, 3), (1, 1, 4)]
    with pytest.raises(ValueError):
        S.connection_matrix(spark, put(tmp_path, "n.txt", "2\n1\n2\n3\n"))
    raw = put(tmp_path, "m.bin", B.matrix_bytes([1, -2, 3, 4]))
    assert rows(B.read_matrix(spark, raw), "left", "right") == [(0, 0, 1), (0, 1, -2), (1, 0, 3), (1, 1, 4)]
    with pytest.raises(Exception, match="square"):
        B.read_matrix(spark, put(tmp_path, "n.bin", b"\0\1\0\1")).collect()


def test_zero_query_files(spark, tmp_path):
    r = put(tmp_path, "r.tsv", "# x\nあ\tい,う\n")
    assert rows(S.zero_query_rules(spark, r).drop("ord"), "value") == [("あ", "い", 0), ("あ", "う", 0)]
    with pytest.raises(Exception, match="trigger"):
        S.zero_query_rules(spark, put(tmp_path, "r2.tsv", "あ\tい,,う")).collect()
    with pytest.raises(ValueError, match="twice"):
        S.zero_query_rules(spark, put(tmp_path, "r3.tsv", "あ\tい,い"), custom=True)
    with pytest.raises(ValueError, match="default"):
        S.zero_query_numbers(spark, r)
    e = put(tmp_path, "e.tsv", "1F600\t😀\tえがお　~\tGRIN\t笑顔1(わらい)\tにこ/顔 \t1\n\t😁\tx\t\t\t\t1\n")
    assert {(k, v) for k, v, *_ in rows(S.zero_query_emoji(spark, e), "ord")} == {(k, "😀") for k in ("えがお", "〜", "笑顔", "わらい", "にこ", "顔")}
    m = put(tmp_path, "m.tsv", "(^^)\tface\tにこ　わら\n")
    assert [r[0] for r in rows(S.zero_query_emoticons(spark, m), "ord")] == ["にこ", "わら"]
    star = put(tmp_path, "s2.tsv", "POS\tCHAR\tReading\td\ta\n記号\t☀\tはれ ひ\t太陽\tsun\n記号\tあ\tx\n")
    assert [r[0] for r in rows(S.zero_query_symbols(spark, star), "ord")] == ["はれ", "ひ", "太陽", "sun"]
    with pytest.raises(ValueError, match="header"):
        S.zero_query_symbols(spark, m)


def test_binary_round_trip():
    assert B.parse_string_array(B.string_array(["", "あ", "い"])) == ["", "あ", "い"]
    with pytest.raises(ValueError):
        B.string_array(["b", "a"])
    entries = [("い", "2", 1), ("あ", "9", 0), ("あ", "1", 3)]
    tokens, strings = B.suggestion_bytes(entries)
    assert B.parse_suggestions(tokens, strings) == [("あ", "9", 0), ("あ", "1", 3), ("い", "2", 1)]
    with pytest.raises(ValueError):
        B.parse_suggestions(struct.pack("<IIHHI", 9, 0, 0, 0, 0), strings)
    assert B.uvarint(300) == b"\xac\x02"


def _packed_rules(spark):
    from glyphmill.operators.ngram import RULE

    rows = [([(1, "指"), (1, "の"), (1, "軌跡")], "a", 1), ([(2, "名詞"), (3, ""), (1, "x" * 200)], "a", 2)] + [([(1, f"w{i:03}"), (1, "b" * (i % 7 + 1))], "b", i) for i in range(40)]
    defs = spark.createDataFrame([(0, "BOS/EOS,*", 1), (1, "名詞,一般", 2), (2, "名詞,数", 3), (3, "動詞,自立", 4)], "id int, name string, line_no int")
    return spark.createDataFrame(rows, RULE), defs, rows


def test_packed_rules_round_trip(spark, tmp_path):
    rules, defs, rows = _packed_rules(spark)
    a, b = str(tmp_path / "a.dat"), str(tmp_path / "b.dat")
    report = I.write(rules, defs, a)
    I.write(rules.orderBy(X.canonical(rules.features).desc()), defs, b)
    data = open(a, "rb").read()
    assert data == open(b, "rb").read() and report["rules"] == 42 and report["bytes"] == len(data) and report["signatures"] == 3
    # classes by name: BOS/EOS, 動詞, 名詞
    assert list(I.parse(data).contexts) == [1, 3, 3, 2]
    want = {tuple((k, "3" if k == 2 else v) for k, v in f) for f, _, _ in rows}
    got = I.read(spark, a).collect()
    assert {tuple((f["kind"], f["value"]) for f in r["features"]) for r in got} == want and len(got) == 42
    # every key is found by its hash: bucket, then remainder
    packed, h = I.parse(data), I.parse(data).header
    hashes = [r[0] for r in spark.createDataFrame([(bytearray(k), i) for i, k in enumerate(packed.keys)], "k binary, i int").orderBy("i").select(X.hash64("k")).collect()]
    for record, value in enumerate(hashes):
        bucket = (value & (1 << 64) - 1) >> (64 - (h["buckets"].bit_length() - 1))
        lo, hi = struct.unpack_from("<II", data, h["buckets_at"] + 4 * bucket)
        found = [struct.unpack_from("<IHI", data, h["entries_at"] + 10 * e) for e in range(lo, hi)]
        assert any((high << 32 | low) == value & (1 << 48) - 1 and r == record for low, high, r in found)


def test_packed_rules_refuse(spark, tmp_path):
    rules, defs, _ = _packed_rules(spark)
    p = str(tmp_path / "a.dat")
    I.write(rules.limit(5), defs, p)
    data = bytearray(open(p, "rb").read())
    for at, what in ((0, "kind"), (4, "version"), (56, "size"), (len(data) - 1, "checksum")):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(I.PackError, match=what):
            I.parse(bytes(bad))
    with pytest.raises(I.PackError, match="cut off"):
        I.parse(b"")
    with pytest.raises(I.PackError, match="order"):
        I.write(rules, defs, p, version=4)
    with pytest.raises(I.PackError, match="twice"):
        I.write(rules.union(rules), defs, p)
    with pytest.raises(Exception, match="coarse"):
        I.write(rules, defs.where("id = 0"), p)
    with pytest.raises(I.PackError, match="no rules"):
        I.write(rules.limit(0), defs, p)
