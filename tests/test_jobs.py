import pytest

from glyphmill.operators.validate import ValidationError
from glyphmill.plans.jobs import build_dictionary, main
from glyphmill.sources import ngram_index as I
from glyphmill.sources import text as S


def put(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content)
    return str(p)


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


ID_DEF = "0 BOS/EOS,*,*,*,*,*,*\n1 名詞,数\n2 名詞,一般\n"


def test_suggestions(spark, tmp_path):
    args = {
        "rules": "ありがとう\t。\n@\tgmail.com\n", "numbers": "default\t年\n12\t月,時\n", "emoji": "1F600\t😀\tありがとう\tGRIN\t\t\t1\n",
        "emoticons": "(^^)\tface\tにこ\n", "symbols": "POS\tCHAR\tReading\n記号\t☀\tはれ\n", "custom": "服を\t着る,着た\nありがとう\t。\n"}
    out = tmp_path / "out"
    made = main(["suggestions", *[x for k, v in args.items() for x in (f"--{k}", put(tmp_path, k, v))], "--output", str(out)], spark)
    assert made == {"entries": 7, "number_entries": 3}
    assert main(["verify-suggestions", "--directory", str(out)], spark) == made
    assert lines(out / "zero_query_data.tsv")[:2] == ["@\tgmail.com", "ありがとう\t。"]
    (out / ".zero_query_number_token.data.crc").unlink()
    (out / "zero_query_number_token.data").write_bytes((out / "zero_query_number_token.data").read_bytes()[:16])
    with pytest.raises(ValidationError, match="number_token"):
        main(["verify-suggestions", "--directory", str(out)], spark)
    with pytest.raises(SystemExit):
        main(["verify-suggestions", "--directory", str(out), "--other", "x"], spark)
    with pytest.raises(SystemExit):
        main(["verify-suggestions"], spark)


def test_english(spark, tmp_path):
    p, ids = put(tmp_path, "e.txt", "# x\nきゃっと\t2\t2\t5\tcat\nきゃっと\t2\t2\t7\t Cat\nゕど\t2\t2\t3\tused to go\n"), put(tmp_path, "id.def", ID_DEF)
    got = main(["validate-english", "--input", p, "--id-def", ids], spark)
    assert (got["entries"], got["primary_entries"], got["review_entries"], got["runtime_entries"], got["min_length"], got["max_length"]) == (3, 2, 1, 1, 2, 4)
    with pytest.raises(Exception, match="out of range"):
        main(["validate-english", "--input", put(tmp_path, "f.txt", "きゃっと\t1\t1\t5\tcat\n"), "--id-def", ids], spark)
    with pytest.raises(ValidationError, match="twice"):
        main(["validate-english", "--input", put(tmp_path, "g.txt", "きゃっと\t2\t2\t5\tcat\nきゃっと\t2\t2\t6\tcat\n")], spark)
    main(["english-report", "--input", p, "--output", str(tmp_path / "c"), "--summary", str(tmp_path / "s.md"), "--quality", str(tmp_path / "q")], spark)
    rows = [r for r in lines(tmp_path / "c") if not r.startswith("reading\t")]
    assert rows == [
        "ゕど\tかど\t1\t0\t1\t0\t\tused to go [cost=3; status=review; score=80; flags=reading-normalized,explanatory-gloss]\t",
        "きゃっと\tきゃっと\t2\t2\t0\t0\tcat [cost=5; status=primary; score=100; flags=-; runtime_cost=5] |  Cat [cost=7; status=primary; score=100; flags=surface-normalized; runtime_surface=Cat; runtime_cost=7]\t\t"]
    quality = [r for r in lines(tmp_path / "q") if not r.startswith("entry_index\t")]
    assert quality[0] == "1\tきゃっと\tきゃっと\tcat\tcat\t5\t5\tprimary\t100\t-" and len(quality) == 3
    assert "| duplicate rows | 0 |" in (tmp_path / "s.md").read_text()


def test_rules_and_dictionary(spark, tmp_path):
    ids = put(tmp_path, "id.def", ID_DEF)
    put(tmp_path, "r/a.ngram", '"a" + pos("名詞")\n"b" + "c"\n')
    report = main(["rules", "--input", str(tmp_path / "r"), "--id-def", ids, "--output", str(tmp_path / "r.dat")], spark)
    assert report["rules"] == 2 and I.read(spark, str(tmp_path / "r.dat")).count() == 2
    put(tmp_path, "u/a.ngram", '"a"\n')
    assert main(["rules", "--input", str(tmp_path / "u"), "--id-def", ids, "--output", str(tmp_path / "u.dat"), "--unigrams"], spark)["version"] == 4
    d = put(tmp_path, "d.txt", "あ\t1\t1\t5\t亜\nい\t1\t1\t5\t井\n")
    more = put(tmp_path, "m.txt", "あ\t2\t2\t9\t亜\nう\t2\t2\t9\t鵜\n")
    rules = spark.createDataFrame([("い", None, "1")], "yomi string, tango string, left_id string")
    rows = build_dictionary(spark, [d], str(tmp_path / "out"), [S.constant_table(spark, [("え", 1, 1, 1, "絵")], "own")], more, rules)
    assert [(r.yomi, r.tango, r.src_rank) for r in rows.orderBy("src_rank", "ord").collect()] == [("あ", "亜", 0), ("え", "絵", 1), ("う", "鵜", 2)]
    matrix = put(tmp_path, "c.txt", "3\n" + "0\n" * 9)
    main(["validate", "--id-def", ids, "--connection", matrix, "--dictionaries", d, more], spark)
    with pytest.raises(ValidationError, match="out of range"):
        main(["validate", "--id-def", ids, "--connection", matrix, "--dictionaries", put(tmp_path, "b.txt", "あ\t3\t1\t5\t亜\n")], spark)
    main(["matrix", "--input", matrix, "--output", str(tmp_path / "c.raw")], spark)
    assert (tmp_path / "c.raw").read_bytes() == bytes(18)


def test_convert(spark, tmp_path):
    a = put(tmp_path, "a.txt", "ふく\t1\t1\t10\t服\nふく\t1\t1\t20\t福\nを\t2\t2\t1\tを\n")
    b = put(tmp_path, "b.txt", "きる\t1\t1\t5\t切る\nきる\t1\t1\t9\t着る\n")
    matrix, ids = put(tmp_path, "c.txt", "3\n" + "0\n" * 9), put(tmp_path, "id.def", ID_DEF)
    inputs = put(tmp_path, "in.txt", "ふくをきる\nx\nふくをきる\n")
    args = ["convert", "--inputs", inputs, "--dictionaries", a, b, "--connection", matrix, "--output", str(tmp_path / "out")]
    got = [(r.line_no, r.value, r.cost) for r in main(args, spark).orderBy("line_no", "rank").collect()]
    assert got == [(1, "服を切る", 16), (2, None, None), (3, "服を切る", 16)]
    put(tmp_path, "rules/r.ngram", '"服" + "を" + "着る"\n')
    got = main([*args, "--n", "2", "--rules", str(tmp_path / "rules"), "--id-def", ids], spark).where("line_no = 1").orderBy("rank")
    assert [(r.rank, r.value) for r in got.collect()] == [(1, "服を着る"), (2, "服を切る")]
    with pytest.raises(ValueError):
        main([*args, "--n", "0"], spark)
