"""Spreadsheet ingestion over month grids derived from line items: a file for every 40th item and year, its quantities by month."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.functions.scalars import is_total_label
from shelfspark.operators import convert, ingest
from shelfspark.operators.durable import durable, new_folder
from shelfspark.sources import bindings as b
from shelfspark.sources import files as files_
from shelfspark.sources.large_csv import large_csv_cells

from .register import Register

REGISTER = query = Register()

YEAR = "(1990 + file // 40)"
GRID = """WITH g AS (SELECT CAST((year(l_shipdate) - 1990) * 40 + l_partkey % 40 AS BIGINT) AS file, l_partkey AS k, month(l_shipdate) AS month, CAST(sum(floor(l_quantity)) AS DOUBLE) AS q FROM lineitem GROUP BY ALL)"""


def sold(spark, sf_dir):
    """file, k (the item), month, q; written once, since cells and headers read it several times."""
    line = b.table(spark, sf_dir, "lineitem")
    file = (F.year("l_shipdate") - 1990) * 40 + F.col("l_partkey") % 40
    return durable(line.groupBy(file.cast("long").alias("file"), F.col("l_partkey").alias("k"), F.month("l_shipdate").alias("month")).agg(F.sum(F.floor("l_quantity")).cast("bigint").alias("q")), "sold")


def cells(spark, sf_dir, q=None):
    """A title, a header in row 3 with month names from column 2, item rows from row 4, a total row."""
    q = sold(spark, sf_dir) if q is None else q
    row, year = (F.col("k") + 10).alias("row_no"), (1990 + F.floor(F.col("file") / 40)).cast("int")
    items = q.select("file", "k").distinct()
    title = items.select("file").distinct()
    body = q.select("file", row, (F.col("month") + 1).cast("int").alias("col_no"), F.when(F.col("k") % 9 == 0, F.format_number("q", 0)).otherwise(F.col("q").cast("string")).alias("value"))
    names = items.select("file", row, F.lit(1).alias("col_no"), F.concat(F.lit("Item "), F.col("k").cast("string")).alias("value"))
    head = title.select("file", F.lit(3).cast("bigint").alias("row_no"), F.explode(F.sequence(F.lit(1), F.lit(13))).alias("col_no"))
    head = head.withColumn("value", F.when(F.col("col_no") == 1, "Item Description").otherwise(F.date_format(F.make_date(year, F.greatest(F.col("col_no") - 1, F.lit(1)), F.lit(1)), "MMM-yy")))
    tops = title.select("file", F.lit(1).cast("bigint").alias("row_no"), F.lit(1).alias("col_no"), F.lit("Sales report").alias("value"))
    total = title.select("file", F.lit(9_000_000).cast("bigint").alias("row_no"), F.explode(F.sequence(F.lit(1), F.lit(13))).alias("col_no")).withColumn("value", F.when(F.col("col_no") == 1, "TOTAL").otherwise("999"))
    return durable(body.union(names).union(head).union(tops).union(total), "cells")


def varied(spark, sf_dir):
    """Of every three files one has another row of three cells above a header of more known names, one has its header below ten rows."""
    c = cells(spark, sf_dir)
    title, k = c.select("file").distinct(), F.col("file") % 3
    more = lambda row, cols: F.explode(F.array(*[F.struct(F.lit(row).cast("bigint").alias("row_no"), F.lit(j).alias("col_no"), F.lit(v).alias("value")) for j, v in cols]))
    above = title.where(k == 1).select("file", more(2, enumerate(["a", "b", "c"], 1)).alias("x")).select("file", "x.*")
    wide = title.where(k == 1).select("file", more(3, [(14, "Qty"), (15, "Unit price")]).alias("x")).select("file", "x.*")
    lines = title.where(k == 2).select("file", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(11).cast("bigint"))).alias("row_no"), F.lit(1).alias("col_no"), F.lit("note").alias("value"))
    return c.withColumn("row_no", F.when(k == 2, F.col("row_no") + 12).otherwise(F.col("row_no"))).unionByName(above).unionByName(wide).unionByName(lines)


def headers(c):
    return ingest.header_rows(c, "sales", 3)


def grid(spark, sf_dir):
    c = cells(spark, sf_dir)
    return ingest.grid_rows(c, headers(c))


def in_year(rows):
    """Grid rows as dated rows of their file's year."""
    return ingest.unpivot_months(rows, (1990 + F.floor(F.col("file") / 40)).cast("int"))


@query("header_score", f"{GRID}, r AS (SELECT file, k, count(*) + 1 AS filled FROM g GROUP BY ALL), f AS (SELECT DISTINCT file FROM g) SELECT file, CAST(k + 10 AS BIGINT) AS row_no, filled, CAST(1 AS BIGINT) AS score FROM r UNION ALL SELECT file, 3, 13, 1 FROM f UNION ALL SELECT file, 1, 1, 0 FROM f UNION ALL SELECT file, 9000000, 13, 0 FROM f")
def header_score(spark, sf_dir):
    return ingest.header_scores(cells(spark, sf_dir), "sales")


@query("header_pick", f"{GRID} SELECT DISTINCT file, CAST(CASE WHEN file % 3 = 2 THEN 15 ELSE 3 END AS BIGINT) AS header_row FROM g")
def header_pick(spark, sf_dir):
    return headers(varied(spark, sf_dir))


@query("sanitize_columns", f"{GRID}, f AS (SELECT DISTINCT file FROM g) SELECT file, CAST(c AS INTEGER) AS col_no, CASE WHEN c = 1 THEN 'item_description' ELSE lower(strftime(make_date({YEAR}, greatest(c - 1, 1), 1), '%b_%y')) END AS name FROM f, range(1, 14) r(c)")
def sanitize_columns(spark, sf_dir):
    c = cells(spark, sf_dir)
    return ingest.column_names(c, headers(c))


@query("rows_from_cells", f"{GRID}, r AS (SELECT file, k, count(*) + 1 AS n FROM g GROUP BY ALL) SELECT file, CAST(k + 10 AS BIGINT) AS row_no, 'Item ' || k AS item, CAST(n AS INTEGER) AS n FROM r UNION ALL SELECT DISTINCT file, 9000000, 'TOTAL', 13 FROM g")
def rows_from_cells(spark, sf_dir):
    c = cells(spark, sf_dir)
    rows = ingest.rows_from_cells(c, headers(c))
    return rows.select("file", "row_no", F.col("cells")["item_description"].alias("item"), F.size("cells").alias("n"))


@query("wide_matrix_detect", f"{GRID} SELECT DISTINCT file, file % 2 = 0 AS wide FROM g")
def wide_matrix_detect(spark, sf_dir):
    """Odd files have five month columns only."""
    return ingest.wide_matrix(cells(spark, sf_dir).where("file % 2 = 0 OR col_no <= 6"))


@query("unpivot_months", f"{GRID} SELECT file, 'Item ' || k AS item, make_date({YEAR}, month, 15) AS date, q AS qty FROM g")
def unpivot_months(spark, sf_dir):
    return in_year(grid(spark, sf_dir)).drop("row_no")


@query("month_type_scan", f"""{GRID}, x AS (SELECT file, month, (file % 4 = 1 AND month = 2) OR (file % 4 = 2 AND month = 3 AND k // 40 % 3 = 0) AS t FROM g),
n AS (SELECT file, month, count(*) FILTER (NOT t) AS n_numbers, count(*) FILTER (t) AS n_texts FROM x GROUP BY ALL)
SELECT file, CAST(month AS INTEGER) AS month, n_numbers, n_texts, CASE WHEN n_numbers = 0 THEN 'refused' WHEN n_texts >= 0.2 * (n_texts + n_numbers) THEN 'mixed' ELSE 'good' END AS kind FROM n""")
def month_type_scan(spark, sf_dir):
    """Some files have a month of words, some a month in which a third of the items has."""
    k = F.col("row_no") - 10
    text = ((F.col("file") % 4 == 1) & (F.col("month") == 2)) | ((F.col("file") % 4 == 2) & (F.col("month") == 3) & (F.floor(k / 40) % 3 == 0))
    return ingest.month_types(grid(spark, sf_dir).withColumn("value", F.when(text, "n/a").otherwise(F.col("value"))))


@query("convert_verify", f"{GRID} SELECT file, CAST(month AS INTEGER) AS month, s AS source, s + CASE WHEN file % 5 = 0 AND month = 4 THEN n ELSE 0 END AS output, NOT (file % 5 = 0 AND month = 4) AS agrees FROM (SELECT file, month, sum(q) AS s, count(*) AS n FROM g GROUP BY ALL)")
def convert_verify(spark, sf_dir):
    """In every fifth file the conversion of April is off by one for each item."""
    g = grid(spark, sf_dir)
    wrong = (F.col("file") % 5 == 0) & (F.month("date") == 4)
    return ingest.convert_verify(g, in_year(g).withColumn("qty", F.col("qty") + F.when(wrong, 1).otherwise(0)))


# What a routed conversion meets, by file % 8: 1 a month of texts only, 2 texts in half of March, 3 a flat tail from October on, 4 such a tail with own
# values in October, 5 a recipe that does not hold, 6 no cells in the last two months, 7 an empty month in the middle and a zero behind a flat value.
ROUTED = f"""{GRID}, x AS (SELECT file, k, month, q, (file % 8 = 1 AND month = 2) OR (file % 8 = 2 AND month = 3 AND k // 40 % 2 = 0) AS t FROM g
    WHERE NOT (file % 8 IN (3, 4) AND month >= 10) AND NOT (file % 8 = 6 AND month > 10) AND NOT (file % 8 = 7 AND month IN (6, 11, 12))
  UNION ALL SELECT file, k, CAST(mo AS BIGINT), q + 1 + CASE WHEN file % 8 = 4 AND mo = 10 AND k // 40 % 5 = 0 THEN 5 ELSE 0 END, false FROM (SELECT file, k, sum(q) AS q FROM g WHERE month < 10 AND file % 8 IN (3, 4) GROUP BY ALL), range(10, 13) r(mo)
  UNION ALL SELECT file, k, mo, CASE WHEN mo = 12 AND k // 40 % 2 = 0 THEN 0 ELSE 7 END, false FROM (SELECT DISTINCT file, k FROM g WHERE file % 8 = 7), (VALUES (11), (12)) r(mo)),
f AS (SELECT DISTINCT file FROM g), n AS (SELECT f.file, CAST(mo AS BIGINT) AS month, count(q) FILTER (NOT t) AS a, count(q) FILTER (t) AS b FROM f CROSS JOIN range(1, 13) r(mo) LEFT JOIN x ON x.file = f.file AND x.month = mo GROUP BY ALL),
why AS (SELECT file, CASE WHEN file % 8 = 5 THEN 'header row out of bounds' WHEN bool_or(a = 0 AND b > 0) THEN 'the column of ' || monthname(make_date(2000, (min(month) FILTER (a = 0 AND b > 0))::INT, 1)) || ' holds texts, no quantities' WHEN max(a) = 0 THEN 'no month has a number' END AS reason,
  list(month ORDER BY month) FILTER (a > 0 AND b > 0 AND b >= 0.2 * (a + b)) AS mixed FROM n GROUP BY file),
live AS (SELECT file, month, row_number() OVER (PARTITION BY file ORDER BY month) AS i, count(*) OVER (PARTITION BY file) AS len FROM n WHERE a > 0),
st AS (SELECT * FROM live WHERE i > 1 AND i < len),
it AS (SELECT st.file, st.month, k, count(*) = any_value(len) - any_value(i) + 1 AND arg_min(q, x.month) > 0 AND min(x.month) = st.month AS whole, min(q) = max(q) AS flat FROM st JOIN x ON x.file = st.file AND x.month >= st.month AND NOT t GROUP BY st.file, st.month, k),
sh AS (SELECT file, month, coalesce(count(*) FILTER (whole AND flat) >= 0.5 * nullif(count(*) FILTER (whole), 0), false) AS pass FROM it GROUP BY ALL),
cut AS (SELECT file, min(month) AS cut FROM (SELECT *, bool_and(pass) OVER (PARTITION BY file ORDER BY month DESC) AS ok FROM sh) WHERE ok GROUP BY ALL),
bo AS (SELECT cut.file, any_value(cut) AS cut, count(*) FILTER (u.q = v.q) / count(*) < 0.9 AS own FROM cut JOIN x u ON u.file = cut.file AND u.month = cut AND NOT u.t AND u.q > 0 JOIN x v ON v.file = cut.file AND v.k = u.k AND v.month = cut + 1 AND NOT v.t GROUP BY cut.file),
kept AS (SELECT live.file, live.month FROM live LEFT JOIN cut USING (file) LEFT JOIN bo USING (file) JOIN why USING (file) WHERE reason IS NULL AND (cut.cut IS NULL OR live.month < cut.cut OR (live.month = cut.cut AND own))),
years AS (SELECT file, CAST(CASE WHEN max(month) > 6 THEN 2001 ELSE 2002 END AS INTEGER) AS year FROM kept GROUP BY ALL)"""


def routed(spark, sf_dir):
    """The conversion of grids of every kind, as of June 2002."""
    q = sold(spark, sf_dir)
    c, k, m = F.col("file") % 8, F.col("k"), F.col("month")
    items = q.select("file", "k").distinct()
    base = q.where(~(c.isin(3, 4) & (m >= 10)) & ~((c == 6) & (m > 10)) & ~((c == 7) & m.isin(6, 11, 12)))
    tail = q.where(c.isin(3, 4) & (m < 10)).groupBy("file", "k").agg(F.sum("q").alias("q")).withColumn("month", F.explode(F.sequence(F.lit(10), F.lit(12))))
    tail = tail.withColumn("q", F.col("q") + 1 + F.when((c == 4) & (m == 10) & (F.floor(k / 40) % 5 == 0), 5).otherwise(0))
    zeros = items.where(c == 7).withColumn("month", F.explode(F.array(F.lit(11), F.lit(12)))).withColumn("q", F.when((m == 12) & (F.floor(k / 40) % 2 == 0), 0).otherwise(7))
    text = ((c == 1) & (m == 2)) | ((c == 2) & (m == 3) & (F.floor(k / 40) % 2 == 0))
    grid_ = base.unionByName(tail.select(base.columns)).unionByName(zeros.select(base.columns)).withColumn("q", F.when(text, "n/a").otherwise(F.col("q").cast("string")))
    row = (k + 10).alias("row_no")
    months = grid_.select("file", row, (m + 1).cast("int").alias("col_no"), F.col("q").alias("value"))
    one = lambda n, v: items.select("file", row, F.lit(n).alias("col_no"), v.alias("value"))
    i = F.floor(k / 40)
    supplier = one(14, F.when(i % 3 == 0, F.concat(F.lit("S"), (F.floor(i / 6) % 3).cast("string"))).otherwise(" "))
    lead = one(15, F.when(i % 6 == 1, "10 WEEKS").when(i % 12 == 4, "soon"))
    rest = items.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(r).cast("bigint").alias("row_no"), F.lit(n).alias("col_no"), F.lit(v).alias("value")) for r, n, v in ((1, 1, "Sales"), (3, 1, "Item"), (3, 2, "Jan"), (9_000_000, 1, "TOTAL"), (9_000_000, 2, "999"), (9_000_001, 2, "5"))])).alias("x")).select("file", "x.*")
    cells_ = months.unionByName(one(1, F.concat(F.lit("Item "), k.cast("string")))).unionByName(supplier).unionByName(lead).unionByName(rest)
    recipes = items.select("file").distinct().select(
        "file", F.lit("wide_matrix").alias("layout"), F.when(c == 5, 0).otherwise(3).alias("header_row"), F.lit(1).alias("item_col"), F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: F.struct(x + 1, x))).alias("month_cols"),
        F.lit(14).alias("supplier_col"), F.lit(15).alias("leadtime_col"), F.lit(9_000_001).alias("n_rows"), F.lit(15).alias("n_cols"),
    )
    return convert.convert(durable(cells_, "cells"), durable(recipes, "recipes"), F.lit("2002-06-15").cast("date"))


@query("convert_readback", f"""{ROUTED}, u AS (SELECT x.file, sum(q) AS units FROM x JOIN kept USING (file, month) WHERE NOT t GROUP BY ALL), i AS (SELECT file, count(DISTINCT k) AS items FROM g GROUP BY ALL),
mk AS (SELECT n.file, list(n.month ORDER BY n.month) FILTER (kept.month IS NOT NULL) AS months_kept, coalesce(list(n.month ORDER BY n.month) FILTER (kept.month IS NULL), []) AS months_dropped FROM n LEFT JOIN kept USING (file, month) GROUP BY n.file)
SELECT file, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN own OR mixed IS NOT NULL THEN 'degraded' ELSE 'confident' END AS outcome, reason, CASE WHEN reason IS NULL THEN items END AS items, CASE WHEN reason IS NULL THEN months_kept::INT[] END AS months_kept,
  CASE WHEN reason IS NULL THEN months_dropped::INT[] END AS months_dropped, year AS assumed_year, CASE WHEN reason IS NULL THEN units::DOUBLE END AS total_units, CASE WHEN reason IS NULL THEN nullif(concat_ws(' ', CASE WHEN own THEN 'Did ' || monthname(make_date(2000, bo.cut::INT, 1)) || ' happen? It was kept, but the months behind it repeat one value like a plan.' END,
  CASE WHEN mixed IS NOT NULL THEN 'Please check March: some of its cells are no numbers.' END), '') END AS question FROM why JOIN i USING (file) JOIN mk USING (file) LEFT JOIN bo USING (file) LEFT JOIN years USING (file) LEFT JOIN u USING (file)""")
def convert_readback(spark, sf_dir):
    """What a conversion tells the user of each file, with the outcome that routes it."""
    return routed(spark, sf_dir).readback


@query("convert_rows", f"""{ROUTED}, r AS (SELECT DISTINCT file, k, k // 40 AS i FROM g), o AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'S' || i // 6 % 3 END AS own, CASE WHEN i % 6 = 1 THEN '10 WEEKS' WHEN i % 12 = 4 THEN 'soon' END AS lead FROM r),
fi AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY k) AS supplier FROM o), ch AS (SELECT *, CASE WHEN supplier IS NOT DISTINCT FROM lag(supplier) OVER (PARTITION BY file ORDER BY k) THEN 0 ELSE 1 END AS c FROM fi),
bl AS (SELECT *, sum(c) OVER (PARTITION BY file ORDER BY k) AS block FROM ch), ld AS (SELECT *, CASE last_value(lead IGNORE NULLS) OVER (PARTITION BY file, block ORDER BY k) WHEN '10 WEEKS' THEN 70 END AS days FROM bl)
SELECT x.file, 'Item ' || k AS item, make_date(year, x.month::INT, 15) AS date, q::DOUBLE AS qty, supplier, days::BIGINT AS lead_days FROM x JOIN kept USING (file, month) JOIN years USING (file) JOIN ld USING (file, k) WHERE NOT t""")
def convert_rows(spark, sf_dir):
    """The dated rows, with suppliers and lead times, of the files that were not refused."""
    return routed(spark, sf_dir).rows.drop("row_no")


@query("assumed_year", f"{GRID} SELECT file, CAST(2002 - CASE WHEN max(month) FILTER (month <= 3 OR file % 2 = 0) > 6 THEN 1 ELSE 0 END AS INTEGER) AS year FROM g GROUP BY ALL HAVING max(month) FILTER (month <= 3 OR file % 2 = 0) IS NOT NULL")
def assumed_year(spark, sf_dir):
    """Odd files end in March; as of June 2002."""
    last = grid(spark, sf_dir).where("month <= 3 OR file % 2 = 0").groupBy("file").agg(F.max("month").alias("last"))
    return last.select("file", ingest.assumed_year(F.col("last"), F.lit("2002-06-15").cast("date")).cast("int").alias("year"))


TAIL = 10


def tailed(spark, sf_dir):
    """Quantities of the grid, but in even files every item repeats its January to September total from month TAIL on; of every third file's
    items, a seventh counts up instead in month TAIL."""
    q = sold(spark, sf_dir).where(f"month < {TAIL} OR file % 2 = 1")
    flat = q.where("file % 2 = 0").groupBy("file", "k").agg((F.sum("q") + 1).alias("q")).withColumn("month", F.explode(F.sequence(F.lit(TAIL), F.lit(12))))
    flat = flat.withColumn("q", F.col("q") + F.when((F.col("file") % 3 == 0) & (F.col("month") == TAIL) & (F.floor(F.col("k") / 40) % 7 == 0), 5).otherwise(0))
    rows = q.select("file", "k", "month", "q").union(flat.select("file", "k", "month", "q"))
    return rows.select("file", F.col("k").alias("row_no"), F.concat(F.lit("Item "), F.col("k").cast("string")).alias("item"), "month", F.col("q").cast("string").alias("value"))


TAILED = f"""{GRID}, h AS (SELECT * FROM g WHERE month < {TAIL} OR file % 2 = 1 UNION ALL SELECT file, k, CAST(mo AS BIGINT), q + 1 + CASE WHEN file % 3 = 0 AND mo = {TAIL} AND k // 40 % 7 = 0 THEN 5 ELSE 0 END FROM (SELECT file, k, sum(q) AS q FROM g WHERE month < {TAIL} AND file % 2 = 0 GROUP BY ALL), range({TAIL}, 13) r(mo)),
l AS (SELECT file, max(month) AS last, min(month) AS first FROM h GROUP BY ALL), st AS (SELECT l.file, CAST(mo AS BIGINT) AS start, last FROM l, range(1, 13) r(mo) WHERE mo < last AND mo > first),
it AS (SELECT st.file, st.start, st.last, h.k, count(*) = st.last - st.start + 1 AND arg_min(h.q, h.month) > 0 AS full_, min(h.q) = max(h.q) AS flat FROM st JOIN h ON h.file = st.file AND h.month >= st.start GROUP BY st.file, st.start, st.last, h.k),
sh AS (SELECT file, start, last, coalesce(count(*) FILTER (full_ AND flat) >= 0.5 * nullif(count(*) FILTER (full_), 0), false) AS pass FROM it GROUP BY ALL),
cut AS (SELECT file, min(start) AS start FROM (SELECT *, bool_and(pass) OVER (PARTITION BY file ORDER BY start DESC) AS ok FROM sh) WHERE ok GROUP BY ALL),
kept AS (SELECT l.file, coalesce(cut.start - 1, l.last) AS last_kept FROM l LEFT JOIN cut USING (file))"""


@query("projection_tail", f"{TAILED} SELECT file, CAST(last_kept AS INTEGER) AS last_kept FROM kept")
def projection_tail(spark, sf_dir):
    return ingest.projection_tail(tailed(spark, sf_dir)).select("file", F.col("last_kept").cast("int").alias("last_kept"))


@query("borderline_month", f"""{TAILED}, two AS (SELECT h.file, h.k, max(q) FILTER (month = last_kept + 1) AS b, max(q) FILTER (month = last_kept + 2) AS n FROM h JOIN kept USING (file) GROUP BY ALL),
x AS (SELECT file, count(*) FILTER (b = n) < 0.9 * count(*) AS own FROM two WHERE b > 0 AND n IS NOT NULL GROUP BY ALL) SELECT kept.file, coalesce(own, false) AS borderline FROM kept LEFT JOIN x USING (file)""")
def borderline_month(spark, sf_dir):
    g = durable(tailed(spark, sf_dir), "tailed")
    return ingest.borderline(g, ingest.projection_tail(g))


@query("recipe_validate", """SELECT CAST(p_partkey AS BIGINT) AS file, CASE p_partkey % 12 WHEN 1 THEN ['unsupported layout'] WHEN 2 THEN ['header row out of bounds'] WHEN 3 THEN ['item column out of bounds'] WHEN 4 THEN ['supplier column out of bounds'] WHEN 5 THEN ['lead-time column out of bounds']
WHEN 6 THEN ['too few months'] WHEN 7 THEN ['month column out of bounds'] WHEN 8 THEN ['month number invalid'] WHEN 9 THEN ['month number repeated'] WHEN 10 THEN ['months not in calendar order'] WHEN 11 THEN ['columns collide'] ELSE [] END AS reasons FROM part""")
def recipe_validate(spark, sf_dir):
    """Recipes of which each twelfth breaks one rule."""
    k = F.col("file") % 12
    base = [(c + 2, c) for c in range(1, 8)]
    months = lambda pairs: F.map_from_entries(F.array(*[F.struct(F.lit(a), F.lit(m)) for a, m in pairs]))
    cols = (
        F.when(k == 6, months(base[:5])).when(k == 7, months([*base[:-1], (99, 7)])).when(k == 8, months([*base[:-1], (9, 13)])).when(k == 9, months([*base[:-1], (9, 6)]))
        .when(k == 10, months([(c + 2, (c + 2) % 12 + 1) for c in range(6, 13)])).otherwise(months(base))
    )
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("file"))
    return ingest.recipe_refusals(part.select(
        "file", F.when(k == 1, "long").otherwise("wide_matrix").alias("layout"), F.when(k == 2, 0).otherwise(3).alias("header_row"), F.when(k == 3, 40).when(k == 11, 4).otherwise(1).alias("item_col"), cols.alias("month_cols"),
        F.when(k == 4, 99).otherwise(2).alias("supplier_col"), F.when(k == 5, -1).when(F.col("file") % 24 != 0, F.lit(None)).otherwise(20).alias("leadtime_col"), F.lit(100).alias("n_rows"), F.lit(30).alias("n_cols"),
    ))


FILL = """WITH r AS (SELECT CAST(p_partkey % 20 AS BIGINT) AS file, CAST(p_partkey // 20 AS BIGINT) AS n, p_partkey AS k FROM part),
x AS (SELECT *, CASE WHEN k % 11 = 3 THEN '' WHEN k % 13 = 3 THEN 'Total' ELSE 'Item ' || k END AS item, CASE n % 6 WHEN 0 THEN 'S' || n // 6 % 3 WHEN 3 THEN 'S' || n // 6 % 3 END AS own, CASE WHEN n % 6 = 1 THEN '10 WEEKS' WHEN n % 12 = 4 THEN 'soon' END AS lead FROM r WHERE NOT (k % 11 = 3 OR k % 13 = 3)),
f AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS supplier FROM x WINDOW w AS (PARTITION BY file ORDER BY n)),
c AS (SELECT *, CASE WHEN supplier IS NOT DISTINCT FROM lag(supplier) OVER (PARTITION BY file ORDER BY n) THEN 0 ELSE 1 END AS change FROM f),
d AS (SELECT *, sum(change) OVER (PARTITION BY file ORDER BY n) AS block FROM c)"""


@query("block_fill_reset", f"""{FILL} SELECT file, n AS row_no, item, supplier, CAST(CASE last_value(lead IGNORE NULLS) OVER (PARTITION BY file, block ORDER BY n) WHEN '10 WEEKS' THEN 70 END AS BIGINT) AS lead_days FROM d""")
def block_fill_reset(spark, sf_dir):
    """Suppliers on the first row of a block and repeated in the middle; lead texts that say nothing; rows without an item, total rows."""
    k, n = F.col("k"), F.col("row_no")
    part = b.table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).cast("long").alias("file"), F.floor(F.col("p_partkey") / 20).cast("long").alias("row_no"), F.col("p_partkey").alias("k"))
    item = F.when(k % 11 == 3, "").when(k % 13 == 3, "Total").otherwise(F.concat(F.lit("Item "), k.cast("string")))
    supplier = F.when(n % 3 == 0, F.concat(F.lit("S"), (F.floor(n / 6) % 3).cast("string"))).otherwise("")
    lead = F.when(n % 6 == 1, "10 WEEKS").when(n % 12 == 4, "soon").otherwise("")
    rows = part.select("file", "row_no", item.alias("item"), F.nullif(supplier, F.lit("")).alias("supplier"), F.nullif(lead, F.lit("")).alias("lead_text"))
    return convert.block_values(rows.where((F.col("item") != "") & ~is_total_label(F.col("item"))))


@query("json_source", """SELECT o_orderkey AS id, CAST(n AS INTEGER) AS pos, 'item ' || o_orderkey AS item, CAST(o_orderkey % 100 + n AS DOUBLE) AS stock FROM orders, range(2) r(n) WHERE o_orderkey % 7 NOT IN (0, 1, 2)""")
def json_source(spark, sf_dir):
    """Health reports as JSON texts: null, empty, cut short, wrapped in an object, with an element that is none."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id")
    one = lambda n: F.concat(F.lit('{"item": "item '), k.cast("string"), F.lit('", "stock": '), (k % 100 + n).cast("string"), F.lit("}"))
    rows = F.concat(F.lit("["), one(0), F.lit(", "), one(1))
    text = F.when(k % 7 == 1, "").when(k % 7 == 2, rows).when(k % 7 == 3, F.concat(F.lit('{"report": '), rows, F.lit("]}"))).when(k % 7 == 4, F.concat(rows, F.lit(', "note", 7]'))).when(k % 7 > 4, F.concat(rows, F.lit("]")))
    return ingest.json_rows(o.withColumn("text", text), "item string, stock double")


@query("reply_repair", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 3 THEN ['a'] WHEN 5 THEN NULL ELSE ['a', 'b'] END AS items, o_orderkey % 6 = 3 AS repaired FROM orders""")
def reply_repair(spark, sf_dir):
    """Replies without a list, with words around it, in a code fence, cut short within the second object, whole, and cut in the first."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    whole, k = '[{"item": "a", "q": 1}, {"item": "b", "q": 2}]', F.col("id") % 6
    text = F.when(k == 0, "no list").when(k == 1, f"Here: {whole} as asked").when(k == 2, f"```json\n{whole}\n```").when(k == 3, whole[:-9]).when(k == 4, whole).otherwise('[{"item": "a')
    return ingest.reply_rows(o.withColumn("text", text), "struct<item:string,q:int>").select("id", F.col("items.item").alias("items"), "repaired")


@query("csv_cells", """WITH s AS (SELECT s_nationkey % 5 AS file, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) + 1 AS r FROM supplier)
SELECT CAST(file AS BIGINT) AS file, CAST(r AS BIGINT) AS row_no, CAST(1 AS INTEGER) AS col_no, CAST(s_suppkey AS VARCHAR) AS value FROM s UNION ALL SELECT file, r, 2, s_name || CASE WHEN file % 2 = 0 THEN ', Ltd' ELSE '' END FROM s
UNION ALL SELECT DISTINCT file, 1, 1, 'key' FROM s UNION ALL SELECT DISTINCT file, 1, 2, 'name' FROM s""")
def csv_cells(spark, sf_dir):
    """Supplier lists as CSV files: a byte-order mark, four delimiters, quoted cells, blank rows, padded cells."""
    s = b.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("file"), "s_suppkey", F.concat("s_name", F.when(F.col("s_nationkey") % 5 % 2 == 0, ", Ltd").otherwise("")).alias("name"))
    sep = F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|"))), (F.col("file") % 4 + 1).cast("int"))
    line = F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), sep, F.lit('"'), "name", F.lit('"'))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("x")))), lambda p: p["x"]), "\n\n")
    files = s.groupBy("file").agg(F.concat(F.lit("\ufeff"), F.lit("key"), F.first(sep), F.lit("name\n"), lines).alias("text"))
    return files_.cells_of(files.select(F.col("file").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")), "csv").select(F.col("file").cast("long").alias("file"), "row_no", "col_no", "value")


@query("large_csv", """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'say "' || o_orderkey || '", twice' WHEN 1 THEN 'first' || chr(10) || 'second; ' || o_orderkey WHEN 2 THEN 'in "the" middle' WHEN 3 THEN '' ELSE o_orderpriority END AS note, floor(o_totalprice)::BIGINT AS price FROM orders)
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, sum(price)::BIGINT AS prices, count(nullif(note, '')) AS notes, count(DISTINCT note) FILTER (note <> '') AS distinct_notes, min(note) FILTER (note <> '') AS first_note, max(note) AS last_note FROM o""")
def large_csv(spark, sf_dir):
    """The orders as CSV files with quotes, delimiters and line ends in cells, read back in splits of any size."""
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(k, "o_orderpriority", F.floor("o_totalprice").alias("price"))
    quoted = F.when(k % 5 == 0, F.concat(F.lit('"say ""'), k.cast("string"), F.lit('"", twice"'))).when(k % 5 == 1, F.concat(F.lit('"first\nsecond; '), k.cast("string"), F.lit('"'))).when(k % 5 == 2, 'in "the" middle').when(k % 5 == 3, '""').otherwise(F.col("o_orderpriority"))
    path = new_folder(spark, "csv")
    o.select(F.concat_ws(";", k.cast("string"), quoted, F.col("price").cast("string"))).write.text(path)
    cells_ = large_csv_cells(spark, path)
    rows = cells_.groupBy("file", "row_no").agg(*[F.max(F.when(F.col("col_no") == i, F.col("value"))).alias(n) for i, n in ((1, "key"), (2, "note"), (3, "price"))])
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"), F.sum(F.col("price").cast("long")).alias("prices"), F.count("note").alias("notes"), F.count_distinct("note").alias("distinct_notes"), F.min("note").alias("first_note"), F.max("note").alias("last_note"))


def workbooks(spark, sf_dir):
    """path, content: supplier lists as workbooks; even ones have a cover sheet before the list."""
    s = b.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("path"), F.col("s_suppkey").cast("long").alias("k"), "s_name")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        data = [["Item Code", "Description", "Qty"], *rows.sort_values("k")[["k", "s_name", "k"]].values.tolist()]
        cover = [["Report"], ["of", "all", "suppliers"]]
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [files_.write_workbook([cover, data] if int(rows["path"].iloc[0]) % 2 == 0 else [data])]})

    return s.groupBy("path").applyInPandas(build, "path string, content binary")


@query("xlsx_cells", """WITH s AS (SELECT s_nationkey % 5 AS f, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) + 1 AS r FROM supplier)
SELECT CAST(f AS BIGINT) AS file, CAST(CASE WHEN f % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS sheet_no, CAST(r AS BIGINT) AS row_no, s_suppkey AS code, s_name AS name FROM s""")
def xlsx_cells(spark, sf_dir):
    cells_ = files_.cells_of(workbooks(spark, sf_dir), "xlsx")
    rows = cells_.groupBy("file", "sheet_no", "row_no").agg(*[F.max(F.when(F.col("col_no") == i, F.col("value"))).alias(n) for i, n in ((1, "code"), (2, "name"), (3, "qty"))])
    return rows.where("code = qty").select(F.col("file").cast("long").alias("file"), "sheet_no", "row_no", F.col("code").cast("long").alias("code"), "name")


@query("sheet_pick", "SELECT DISTINCT CAST(s_nationkey % 5 AS BIGINT) AS file, CAST(CASE WHEN s_nationkey % 5 % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS sheet_no FROM supplier")
def sheet_pick(spark, sf_dir):
    """The list, not the cover sheet in front of it."""
    return ingest.sheet_pick(files_.cells_of(workbooks(spark, sf_dir), "xlsx"), "inventory").select(F.col("file").cast("long").alias("file"), "sheet_no")
