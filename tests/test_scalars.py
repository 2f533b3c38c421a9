import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scalars as sc


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (sc.to_num, {"1,200": 1200, "S$1,200": 1200, "(50)": -50, "120 KG": 120, "ABC123": None, "12-34": None, "": None, None: None, "rm 5": 5, "1.5E3": 1500, ".5": 0.5, "(S$ 7.25)": -7.25, "-3": -3, "N/A": None, "()": None}),
    (sc.num_sql, {"RM5": 0, "12-34": 12, "(1,5)": -15, None: None, "": 0, "US$ 2.5": 2.5}),
    (sc.num_cell, {"1,000": 1000, "12 kg": None, "NaN": None, "-.5": -0.5, "true": None}),
    (sc.parse_quantity, {"order -1,250.5 now 3": -1250.5, "none": None, "7": 7}),
    (sc.euro_number, {"1.234,56": True, "1.234.567": True, "12,5": True, "1.234": False, "1,234": False, "12": False}),
    (sc.match_key, {"Straße 5-A": "strasse5a", "  ": ""}),
    (sc.annotation_head, {"MILK ← out of stock": "MILK", "A<-b": "A", "x // y": "x", "plain": "plain"}),
    (sc.stripped_key, {"Acme Trading Pte Ltd": "acme", "Trading Co": "tradingco"}),
    (sc.cell_month, {"Jan-26": 1, "2026-03": 3, "07/2026": 7, "M12": 12, "M13": 0, "september": 9, "5": 0, "": 0, "Foo-26": 0}),
    (sc.lead_time_days, {"3 weeks": 21, "10-12 DAYS": 12, "1.5 months": 45, "soon": None}),
    (sc.confidence_norm, {"med": "MEDIUM", "h": "HIGH", "what": "INSUFFICIENT_DATA", "": "", None: None}),
    (sc.csv_safe_cell, {"=1": "'=1", "@x": "'@x", "ok": "ok", None: ""}),
    (sc.looks_unit, {"ctn": True, "toolong7": False, "k9": False, None: False}),
    (sc.group_slug, {"A & B": "sg-a-b"}),
    (sc.is_total_label, {"grand total": True, "TOTAL MIX": False}),
    (sc.supplier_type_of_item, {"Cheese bun": "local", "GOUDA": "import", "rice": "other"}),
]


@pytest.mark.parametrize(("f", "cases"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_cells(spark, f, cases):
    assert column(spark, f, list(cases)) == list(cases.values())


def test_months(spark):
    day = lambda y, m: datetime.date(y, m, 1)
    cases = {"2026-06-15": day(2026, 6), "15/06/2026": day(2026, 6), "15-Jun-26": day(2026, 6), "2026/6/1 10:00": day(2026, 6), "46188": day(2026, 6), "13/13/2026": None, "15-Sep-2026": day(2026, 9), "1850-01-01": None, "x": None, "90000": None, "15-June-2026": day(2026, 6)}
    assert column(spark, lambda c: sc.month_key(c, F.lit(True)), list(cases)) == list(cases.values())
    assert column(spark, lambda c: sc.month_key(c, F.lit(False)), ["06/15/2026"]) == [day(2026, 6)]


def test_totals_need_a_blank_unit_at_an_edge(spark):
    df = spark.createDataFrame([("Grand Total:", "KG"), ("TOTAL CHEESE", ""), ("TOTAL CHEESE", "KG"), ("totally", "")], "n string, u string")
    assert [r.t for r in df.select(sc.is_total_row(F.col("n"), F.col("u")).alias("t")).collect()] == [True, True, False, False]
