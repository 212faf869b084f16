import io
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, similarity, text
from tallyforge.operators import linking, matching
from tallyforge.sources import parsing


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    got = column(spark, ["2026-09-14", "09/14/26", "14-Sep-2026", "Sep 14, 2026", "46279", "2026-09-14T00:00:00", "14.09.2026", "2026-02-31", "not a date", "", None, "01/02/71"], dates.parse_any)
    assert got == [date(2026, 9, 14)] * 7 + [None] * 4 + [date(1971, 1, 2)]


def test_all_formats(spark):
    day = date(2025, 5, 14)
    names = [n for n in dates.FORMATS if n != dates.EXCEL]
    assert len(names) == 19
    got = column(spark, [day.strftime(n) for n in names] + ["14-may-25", "2025-05-14 07:30:00.5+02:00", "45791.25"], dates.parse_any)
    assert got == [day] * 22
    rows = spark.createDataFrame([(1, "45791"), (1, "45792"), (1, "x")], "g int, v string")
    r = dates.infer_formats(rows, "v", ["g"]).first()
    assert (r["format"], r["n_parsed"]) == (dates.EXCEL, 2)


def test_column_format_first(spark):
    rows = spark.createDataFrame([(0, "03/04/2026", "%d/%m/%Y"), (1, "03/04/2026", "%Y-%m-%d"), (2, "13/04/2026", "%Y-%m-%d"), (3, "03/03/2026", "%Y-%m-%d"), (4, "2026-04-03", "%d/%m/%Y"), (5, "03/04/2026", None)], "i int, v string, f string")
    rows = rows.withColumn("p", dates.parsed_by_format(F.col("v")))
    got = rows.select("i", dates.read_date(F.col("p"), F.col("f")).alias("d"), dates.ambiguous_off_format(F.col("v"), F.col("p"), F.col("f")).alias("a")).orderBy("i").collect()
    assert [(r["d"], r["a"]) for r in got] == [(date(2026, 4, 3), False), (date(2026, 3, 4), True), (date(2026, 4, 13), False), (date(2026, 3, 3), False), (date(2026, 4, 3), False), (date(2026, 3, 4), True)]


def test_weekday_date(spark):
    anchors = F.array(F.lit("2026-09-20").cast("date"))
    row = spark.range(1).select(dates.weekday_date(F.lit(9), F.lit(14), F.lit(0), anchors).alias("a"), dates.weekday_date(F.lit(2), F.lit(30), F.lit(0), anchors).alias("b")).first()
    assert (row["a"], row["b"]) == (date(2026, 9, 14), None)


@pytest.mark.parametrize(("values", "want"), [(["2026-09-14", "2026-09-20"], ("%Y-%m-%d", False)), (["09/14/2026", "10/01/2026"], ("%m/%d/%Y", False)), (["14/09/2026", "01/10/2026"], ("%d/%m/%Y", False)), (["03/04/2026", "05/06/2026"], ("%m/%d/%Y", True))])
def test_format_inference(spark, values, want):
    rows = spark.createDataFrame([(1, v) for v in values], "g int, v string")
    r = dates.infer_formats(rows, "v", ["g"]).first()
    assert (r["format"], r["ambiguous"]) == want


def test_numbers_phones_licences(spark):
    assert column(spark, ["36,5", "1,036", "40 hrs", "16h", "24 hours", "-8", "about 7", "", None], text.parse_number) == [36.5, 1036, 40, 16, 24, -8, None, None, None]
    assert column(spark, ["718-555-0201", "(718) 555 0201", "1-718-555-0201", "+1 718.555.0201 x45", "555-0201", "", "n/a"], text.normalize_phone) == ["+17185550201"] * 4 + [None] * 3
    assert column(spark, ["rn 551203", "RN#551203", "x 12", ""], text.canonical_license) == ["RN-551203", "RN-551203", "X12", None]


def test_shift_tokens(spark):
    tokens = ["7a-3p", "07:00-15:00", "7a–3p", "7a to 3p", "7am - 3pm", "11p-7a", "7:30a-4p", "12a-8a", "12p-8p", "7a-3p/3p-11p", "7a-3p*", "7a-3p (float BYS)", "OFF", "—", "", None, "PTO", "hello", "7-3", "25:00-3:00", "7a-", "09/14"]
    got = [(r["kind"], r["start_min"], r["hours"], r["note"]) for r in column(spark, tokens, text.parse_shift)]
    assert got[:5] == [("shift", 420, 8.0, None)] * 5
    assert got[5:9] == [("shift", 1380, 8.0, None), ("shift", 450, 8.5, None), ("shift", 0, 8.0, None), ("shift", 720, 8.0, None)]
    assert got[9:12] == [("shift", 420, 16.0, "double"), ("shift", 420, 8.0, "*"), ("shift", 420, 8.0, "(float bys)")]
    assert [g[0] for g in got[12:17]] == ["off"] * 5 and [g[0] for g in got[17:]] == [None] * 5


def test_names():
    parse = linking.parse_person_name
    assert parse("BELL, MARCUS") == parse("Marcus Bell, RN") == parse("Dr. Marcus Bell") == {"family": "bell", "given": "marcus", "initial": "m", "middle": None, "suffix": None}
    assert parse("Maria de la Cruz")["family"] == "de la cruz" and parse("van Dyke, Peter")["family"] == "van dyke"
    assert parse("BELL JR, MARCUS")["suffix"] == "jr" and parse("José Muñoz")["family"] == "munoz"
    assert (parse("M. Bell")["given"], parse("M. Bell")["initial"], parse("Bell")["family"], parse("Bell")["initial"], parse(" ")["family"]) == (None, "m", "bell", None, None)


def test_folded_names():
    parse = linking.parse_person_name
    assert (parse("Al Smith")["given"], parse("Le Brown")["given"], parse("St John")["given"]) == ("al", "le", "st")
    assert (parse("Łukasz Strauß")["given"], parse("Łukasz Strauß")["family"], parse("Ærø, Jørn")["family"]) == ("lukasz", "strauss", "aero")
    assert (parse("Jr")["family"], parse("Jr")["suffix"], parse("Bell (open [note) Jr")["suffix"]) == ("jr", None, "jr")


def test_json_bids():
    bid = lambda t: parsing.sniff_json(t.encode()).score
    assert bid('[{"a": 1}]') == bid('{"rows": [{"a": 1}]}') == bid('{"a": 1}\n{"a": 2}\n') == bid('{"a": 1}') == 0.95
    assert bid("[1, 2, 3]") == bid("{braces} are not JSON") == bid("[note] a, b") == 0


def test_unquoted_names_under_a_title():
    data = b"Payroll of May\nid,name,hours\n" + b"".join(b"%d,BELL, MARCUS,4%d\n" % (i, i) for i in range(4))
    table = parsing.extract_csv(data)[0]
    assert table.columns == ["id", "name", "hours"] and table.rows[0] == ["0", "BELL, MARCUS", "40"]


def test_compare_given(spark):
    nick = spark.createDataFrame([("marc", "marcus"), ("bob", "robert")], "nickname string, formal string")
    pairs = [("Marc", "Marcus", "nickname"), ("Bob", "Robert", "nickname"), ("Sam", "Samantha", "nickname"), ("Marcus", "Marcos", "fuzzy"), ("M.", "Marcus", "initial"), ("M.", "Joan", "disagree"), ("Marcus", "Maria", "disagree"), ("Mark", "Marcus", "disagree")]
    rows = spark.createDataFrame([(i, f"{a} X", f"{b} X") for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    a = linking.person_keys(rows, "a", nick).select("i", F.col("key").alias("ka"))
    b = linking.person_keys(rows, "b", nick).select("i", F.col("key").alias("kb"))
    got = a.join(b, "i").select("i", linking.compare_given(F.col("ka"), F.col("kb")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [w for *_, w in pairs]


def test_similarity():
    assert similarity.jaro_winkler("marcus", "marcos") == pytest.approx(0.9333, abs=1e-4)
    assert similarity.jaro_winkler("maria", "mario") == pytest.approx(0.92)
    assert similarity.token_sort_ratio("a b", "b a") == 100 and similarity.indel_ratio("abc", "abd") == pytest.approx(66.67, abs=0.01)


def test_assignment():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n in (1, 3, 5):
        cost = rng.random((n, n + 2))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n + 2), n))
        assert sum(cost[i, j] for i, j in enumerate(matching.assign(cost))) == pytest.approx(best)


def test_csv_parsing():
    t = parsing.extract_csv("Report of May\n\nname;hired;note\nJosé;2020-01-02;\"two\nlines\"\nAnn;2021-03-04;x\nname;hired;note\n;;\n".encode("cp1252"))[0]
    assert t.columns == ["name", "hired", "note"] and t.rows == [["José", "2020-01-02", "two\nlines"], ["Ann", "2021-03-04", "x"]] and t.lines == [4, 6]
    merged = parsing.merge_unquoted_names([["name", "h"], ["BELL", " M", "1"], ["FOX", " A", "2"], ["LEE", " B", "3"]])
    assert merged[1] == ["BELL, M", "1"] and parsing.unique_columns(["a", "", "a"]) == ["a", "column_2", "a_2"]
    assert parsing.run_auction(b"%PDF-1.4")[0] is None and parsing.run_auction(b"a,b\n1,2\n")[0] == "csv" and parsing.run_auction(b'[{"a": 1}]')[0] == "json"


def test_json_parsing():
    t = parsing.extract_json(b'{"x": [{"a": {"b": 1}, "c": [1, 2]}, {"a": null, "c": " "}], "n": 3}')[0]
    assert (t.sheet, t.columns, t.rows) == ("x", ["a.b", "c", "a"], [["1", "[1, 2]", None], [None, None, None]])
    assert parsing.extract_json(b'{"a": 1}\n{"a": 2}\n')[0].rows == [["1"], ["2"]]


def test_xlsx_parsing():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>day</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Ann</t></is></c><c r="B2" s="1"><v>46279</v></c></row><row r="3"><c r="A3"><v>40.0</v></c></row></sheetData></worksheet>')
    assert parsing.run_auction(out.getvalue())[0] == "xlsx"
    t = parsing.extract_xlsx(out.getvalue())[0]
    assert (t.sheet, t.columns, t.rows) == ("S", ["name", "day"], [["Ann", "2026-09-14"], ["40", None]])
