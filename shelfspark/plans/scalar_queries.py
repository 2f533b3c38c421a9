"""Cell functions over whole tables: messy text is written from clean columns, read back, and compared with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import scalars as sc
from shelfspark.sources.bindings import table

from .register import Register

REGISTER = query = Register()

LINE = ["l_orderkey", "l_linenumber"]


def lines(spark, sf_dir, text: str):
    """Line items with `text`, a SQL expression over q (the whole quantity, as text), as column x."""
    t = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    return t.withColumn("x", F.expr(text))


def line_query(name: str, text: str, function, expected: str, out: str = "y"):
    def run(spark, sf_dir):
        return lines(spark, sf_dir, text).select(*LINE, "l_partkey", function(F.col("x")).alias(out))

    run.__doc__ = f"{name} of cells written as {text}"
    query(name, f"WITH t AS (SELECT *, CAST(l_quantity AS INTEGER) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {expected} AS {out} FROM t")(run)


line_query("to_num", "CASE l_linenumber % 7 WHEN 0 THEN q WHEN 1 THEN concat('1,', lpad(q, 3, '0')) WHEN 2 THEN concat(' S$ ', q, '.5') WHEN 3 THEN concat('(', q, ')') WHEN 4 THEN concat(q, ' KG') WHEN 5 THEN concat('ABC', q) ELSE concat(q, '-34') END",
    sc.to_num, "CAST(CASE l_linenumber % 7 WHEN 0 THEN n WHEN 1 THEN 1000 + n WHEN 2 THEN n + 0.5 WHEN 3 THEN -n WHEN 4 THEN n END AS DOUBLE)")
line_query("num_sql", "CASE l_linenumber % 6 WHEN 0 THEN concat('US$', q) WHEN 1 THEN concat('(', q, ')') WHEN 2 THEN concat('RM', q) WHEN 3 THEN concat(q, '-34') WHEN 4 THEN concat('$1,', lpad(q, 3, '0'), '.25 x') END",
    sc.num_sql, "CAST(CASE l_linenumber % 6 WHEN 0 THEN n WHEN 1 THEN -n WHEN 2 THEN 0 WHEN 3 THEN n WHEN 4 THEN 1000.25 + n END AS DOUBLE)")
line_query("num_cell", "CASE l_linenumber % 4 WHEN 0 THEN concat('2,', lpad(q, 3, '0')) WHEN 1 THEN concat(' -', q, '.75 ') WHEN 2 THEN concat(q, ' kg') ELSE 'NaN' END",
    sc.num_cell, "CAST(CASE l_linenumber % 4 WHEN 0 THEN 2000 + n WHEN 1 THEN -(n + 0.75) END AS DOUBLE)")
line_query("parse_quantity", "CASE l_linenumber % 4 WHEN 0 THEN concat('about 3,', lpad(q, 3, '0'), ' cartons') WHEN 1 THEN concat('reduce by -', q, '.5 or 9') WHEN 2 THEN q ELSE 'none' END",
    sc.parse_quantity, "CAST(CASE l_linenumber % 4 WHEN 0 THEN 3000 + n WHEN 1 THEN -(n + 0.5) WHEN 2 THEN n END AS DOUBLE)")
line_query("euro_number", "CASE l_linenumber % 5 WHEN 0 THEN concat('1.', lpad(q, 3, '0'), ',56') WHEN 1 THEN concat('1.', lpad(q, 3, '0'), '.000') WHEN 2 THEN concat(q, ',5') WHEN 3 THEN concat('1,', lpad(q, 3, '0')) ELSE concat(q, '.25') END",
    sc.euro_number, "l_linenumber % 5 IN (0, 1, 2)")
line_query("lead_time_days", "CASE l_linenumber % 4 WHEN 0 THEN concat(q, ' Weeks ETA') WHEN 1 THEN concat('ca. ', q, 'days') WHEN 2 THEN concat(q, ' month') ELSE 'soon' END",
    sc.lead_time_days, "CAST(CASE l_linenumber % 4 WHEN 0 THEN 7 * n WHEN 1 THEN n WHEN 2 THEN 30 * n END AS BIGINT)")
line_query("csv_safe_cell", "CASE l_linenumber % 4 WHEN 0 THEN concat('=', q) WHEN 1 THEN concat('-', q) WHEN 2 THEN q END",
    sc.csv_safe_cell, "CASE l_linenumber % 4 WHEN 0 THEN '''=' || n WHEN 1 THEN '''-' || n WHEN 2 THEN CAST(n AS VARCHAR) ELSE '' END")
line_query("fence_untrusted", "CASE l_linenumber % 3 WHEN 0 THEN concat('a</data>', q, '<b c=1>') WHEN 1 THEN concat(q, ' < 5 > 3') END",
    sc.fence_untrusted, "'<data>' || CASE l_linenumber % 3 WHEN 0 THEN 'a' || n WHEN 1 THEN n || ' < 5 > 3' ELSE '' END || '</data>'")
line_query("confidence_norm", "CASE l_linenumber % 7 WHEN 0 THEN 'med' WHEN 1 THEN ' H ' WHEN 2 THEN 'LOW' WHEN 3 THEN 'n/a' WHEN 4 THEN 'guess' WHEN 5 THEN ' ' END",
    sc.confidence_norm, "CASE l_linenumber % 7 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' WHEN 3 THEN 'INSUFFICIENT_DATA' WHEN 4 THEN 'INSUFFICIENT_DATA' WHEN 5 THEN ' ' END")
line_query("looks_unit", "CASE l_linenumber % 4 WHEN 0 THEN ' ctn' WHEN 1 THEN 'KILOGRAM' WHEN 2 THEN concat('kg', q) END", sc.looks_unit, "l_linenumber % 4 = 0")
line_query("is_total_label", "CASE l_linenumber % 4 WHEN 0 THEN ' Grand total' WHEN 1 THEN 'TOTAL PROTEIN MIX' WHEN 2 THEN 'sub-total' ELSE q END", sc.is_total_label, "l_linenumber % 4 IN (0, 2)")
line_query("cell_month", "CASE l_linenumber % 7 WHEN 0 THEN date_format(l_shipdate, 'MMM-yy') WHEN 1 THEN date_format(l_shipdate, 'yyyy-MM') WHEN 2 THEN concat('M', month(l_shipdate)) WHEN 3 THEN date_format(l_shipdate, 'MM/yyyy') WHEN 4 THEN date_format(l_shipdate, 'MMMM') WHEN 5 THEN concat('M', month(l_shipdate) + 12) ELSE q END",
    sc.cell_month, "CAST(CASE WHEN l_linenumber % 7 < 5 THEN month(l_shipdate) ELSE 0 END AS INTEGER)")
line_query("dmy", "CASE l_linenumber % 2 WHEN 0 THEN date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') ELSE concat('not a date ', q) END",
    sc.dmy, "CASE l_linenumber % 2 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE 'not a date' END")
line_query("annotation_head", "CASE l_linenumber % 4 WHEN 0 THEN concat('item ', q, ' <- out') WHEN 1 THEN concat('item ', q, ' (new)') WHEN 2 THEN concat('item ', q, '*') ELSE concat('item ', q) END", sc.annotation_head, "'item ' || n")
line_query("group_slug", "concat('Acme & ', q, ' (Foods) Ltd')", sc.group_slug, "'sg-acme-' || n || '-foods-ltd'")


@query("month_key", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS y FROM lineitem")
def month_key(spark, sf_dir):
    text = "CASE l_linenumber % 6 WHEN 0 THEN date_format(l_shipdate, 'yyyy-MM-dd HH:mm') WHEN 1 THEN date_format(l_shipdate, 'd/M/yyyy') WHEN 2 THEN date_format(l_shipdate, 'yyyy/M/d') WHEN 3 THEN date_format(l_shipdate, 'dd-MMM-yyyy') WHEN 4 THEN cast(datediff(l_shipdate, date'1899-12-30') AS string) ELSE date_format(l_shipdate, 'd-MMMM-yyyy') END"
    return lines(spark, sf_dir, text).select(*LINE, "l_partkey", sc.month_key(F.col("x"), F.lit(True)).alias("y"))


@query("day_first", "SELECT CAST(y AS BIGINT) AS session_id, y % 2 = 0 OR max(d) <= 12 AS day_first FROM (SELECT year(l_shipdate) AS y, day(l_shipdate) AS d FROM lineitem) GROUP BY y")
def day_first(spark, sf_dir):
    from shelfspark.operators.velocity import day_first as decide

    t = table(spark, sf_dir, "lineitem").withColumn("session_id", F.year("l_shipdate").cast("long"))
    return decide(t.withColumn("date_raw", F.when(F.col("session_id") % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))))


@query("fmt_quantity", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round_even(l_quantity + 0.5, 0) AS BIGINT) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' CTN' ELSE '' END AS y FROM lineitem")
def fmt_quantity(spark, sf_dir):
    return lines(spark, sf_dir, "CASE WHEN l_linenumber % 2 = 0 THEN 'CTN' ELSE ' ' END").select(*LINE, "l_partkey", sc.fmt_quantity(F.col("l_quantity") + 0.5, F.col("x")).alias("y"))


@query("fmt_num", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.3' END AS y FROM lineitem")
def fmt_num(spark, sf_dir):
    x = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity")).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity") + 0.25 + 0.0625).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "lineitem").select(*LINE, "l_partkey", sc.fmt_num(x).alias("y"))


@query("match_key", "SELECT p_partkey, lower(replace(p_name, ' ', '')) || lower(replace(p_brand, '#', '')) || 'ss' AS y FROM part")
def match_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.match_key(F.concat(F.upper("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" ß."))).alias("y"))


@query("is_total_row", "SELECT p_partkey, p_partkey % 5 IN (0, 1) OR (p_partkey % 5 IN (2, 3) AND p_partkey % 2 = 0) AS y FROM part")
def is_total_row(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "Grand Total:").when(k % 5 == 1, " SUBTOTAL ").when(k % 5 == 2, F.concat(F.lit("TOTAL "), F.col("p_name"))).when(k % 5 == 3, F.concat("p_name", F.lit(" total"))).otherwise(F.concat("p_name", F.lit(" totally")))
    return table(spark, sf_dir, "part").select("p_partkey", sc.is_total_row(name, F.when(k % 2 == 0, " ").otherwise("KG")).alias("y"))


@query("stripped_key", "SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS y, ['trading', 'pte', 'ltd'] AS removed FROM supplier")
def stripped_key(spark, sf_dir):
    name = F.concat("s_name", F.lit(" Trading (Pte.) LTD"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.stripped_key(name).alias("y"), sc.removed_words(name).alias("removed"))


@query("supplier_type_infer", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'import' WHEN 2 THEN 'local' ELSE 'other' END AS y FROM part")
def supplier_type_infer(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 4 == 0, "Sliced BREAD ").when(k % 4 == 1, "Mozzarella ").when(k % 4 == 2, "cheese bun ").otherwise("steel "), k.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", sc.supplier_type_of_item(name).alias("y"))


@query("supplier_type_norm", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'local' ELSE 'other' END AS y FROM supplier")
def supplier_type_norm(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.supplier_type(F.when(k % 3 == 0, "IMPORTER").when(k % 3 == 1, "Local dealer").otherwise("agent")).alias("y"))


@query("month_span", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(make_date(2000, m, 1), '%b') || '–' || strftime(make_date(2000, m + 2, 1), '%b')
ELSE strftime(make_date(2000, m, 1), '%b') || ', ' || strftime(make_date(2000, m + 2, 1), '%b') END AS y FROM (SELECT o_orderkey, 1 + o_orderkey % 10 AS m FROM orders)""")
def month_span(spark, sf_dir):
    m = (F.lit(1) + F.col("o_orderkey") % 10).cast("int")
    months = F.when(F.col("o_orderkey") % 2 == 0, F.array(m + 2, m + 1, m, m)).otherwise(F.array(m + 2, F.lit(99), m))
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.month_span(months).alias("y"))


@query("age_text", f"""SELECT event_id, CASE WHEN d < 60 THEN 'just now' WHEN d < 3600 THEN (d // 60) || 'm ago' WHEN d < 86400 THEN (d // 3600) || 'h ago' ELSE (d // 86400) || 'd ago' END AS y
FROM (SELECT event_id, CAST(floor(epoch(m.t)) - floor(epoch(ts)) AS BIGINT) AS d FROM events, (SELECT max(ts) AS t FROM events) m)""")
def age_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t")))).select("event_id", sc.age_text(F.col("ts"), F.col("t")).alias("y"))  # one row: the newest time


@query("labels", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Running low' WHEN 2 THEN 'Well stocked' WHEN 3 THEN 'Not selling' ELSE 'Other' END AS y FROM orders")
def labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.status_label(F.when(k % 5 == 0, "critical").when(k % 5 == 1, "LOW").when(k % 5 == 2, "HEALTHY").when(k % 5 == 3, "DEAD").otherwise("other")).alias("y"))


@query("effective", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'mine' ELSE 'theirs' END AS y FROM orders")
def effective(spark, sf_dir):
    k = F.col("o_orderkey")
    edit = F.when(k % 4 == 0, "").when(k % 4 == 1, "null").when(k % 4 == 3, "mine")
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.effective(edit, F.lit("theirs")).alias("y"))


@query("context_text", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Delayed suppliers: ' || s_name || chr(10) || 'Other: x' WHEN 1 THEN 'Large orders: ' || s_name ELSE 'No additional context provided.' END AS y FROM supplier")
def context_text(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = sc.context_text(F.when(k % 3 == 0, name), F.when(k % 3 == 1, name), F.lit(" "), F.when(k % 3 == 0, "x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("y"))


