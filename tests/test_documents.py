from datetime import date

from pyspark.sql import functions as F

from ledgerline.operators import documents as d

HTML = """<?xml version="1.0"?><html><body><script>no</script><h1>Report</h1><p>Opening words.</p>
<h2>Results</h2><p>(in thousands)</p><table><tr><th></th><th>Three months ended June 30, 2024</th></tr><tr><td>Net revenue</td><td>$1,200</td></tr><tr><td>Net loss</td><td>(35)</td></tr></table>
<div>Plain &amp; simple<span> text</span></div><div><p>Inside</p></div><p>Item 2. Other</p><p>Tail one<p>Tail two</body></html>"""


def test_blocks_in_document_order():
    got = [(b[0], b[1], b[2]) for b in d.parse_blocks(HTML)]
    assert got == [
        ("prose", "Report", "Opening words."), ("prose", "Results", "(in thousands)"), ("table", "Results", None), ("prose", "Results", "Plain & simple text"),
        ("prose", "Results", "Inside"), ("prose", "Item 2. Other", "Tail one"), ("prose", "Item 2. Other", "Tail two"),
    ]
    table = d.parse_blocks(HTML)[2]
    assert table[3] == "(in thousands)" and table[4][1] == ["Net revenue", "$1,200"] and table[5] is False
    assert d.parse_blocks(None) == [] and d.parse_blocks("") == []
    assert d.parse_blocks('<table><tr><td colspan="2">x</td></tr></table>')[0][5] is True


def test_table_facts_and_gap_fill(spark):
    docs = spark.createDataFrame([("f1", HTML)], "doc string, html string")
    t = d.html_blocks(docs).where("kind = 'table'").withColumns({"fiscal_period": F.lit("Q2"), "period_end_date": F.lit(date(2024, 6, 30))})
    found = d.table_facts(t)
    assert {(r.concept, r.val) for r in found.collect()} == {("revenue", 1_200_000.0), ("net_income", -35_000.0)}
    assert d.table_facts(t.withColumn("fiscal_period", F.lit("FY"))).count() == 0
    assert d.table_facts(t.withColumn("caption", F.lit("EUR thousands"))).count() == 0
    have = spark.createDataFrame([("f1", "revenue", 5.0)], "doc string, concept string, val double")
    want = spark.createDataFrame([("f1", "revenue"), ("f1", "net_income"), ("f1", "gross_profit")], "doc string, concept string")
    assert {(r.concept, r.val, r.source) for r in d.fill_gaps(have, found, want).collect()} == {("revenue", 5.0, "xbrl"), ("net_income", -35_000.0, "html_table_fallback")}


def test_numeric_cells(spark):
    cells = ["($18.5)", "$(5)", "1,234", "-7", "", "n/a", "(12)", None, "12%"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", d.numeric_cell(F.col("c")).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [-18.5, None, 1234.0, -7.0, None, None, -12.0, None, None]


def test_packing_is_greedy_and_respects_sections(spark):
    rows = [("x", 0, 0, "A", "a" * 900), ("x", 1, 1, "A", "b" * 600), ("x", 2, 2, "A", "c"), ("x", 3, 3, "B", "d" * 2000), ("x", 4, 4, "B", "e"), ("y", 0, 0, "A", "z")]
    got = d.pack_chunks(spark.createDataFrame(rows, "doc string, block_order int, tie bigint, section string, text string"), ["doc"]).orderBy("doc", "chunk_no").collect()
    assert [(r.doc, r.section, r.source_orders) for r in got] == [("x", "A", [0, 1]), ("x", "A", [2]), ("x", "B", [3]), ("x", "B", [4]), ("y", "A", [0])]
    assert got[0].text == "a" * 900 + " " + "b" * 600
