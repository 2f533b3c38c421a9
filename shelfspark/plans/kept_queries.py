"""Sales that arrive in files: facts and figures by item are kept, and a new file costs only the sessions that it touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import velocity
from shelfspark.operators.durable import new_folder
from shelfspark.operators.kept import Kept
from shelfspark.sources import bindings as b

from .register import Register

REGISTER = query = Register()

LATE = 1997  # sales of this year and later come in the second file; the first lines of its orders in a third one


def tables(spark, path, sales):
    """The kept sums by date, the cube by month that follows from them, and the figures by item that follow from the cube."""
    parts = Kept(spark, f"{path}/parts", velocity.by_date(sales).schema)
    cube = Kept(spark, f"{path}/cube", velocity.by_month(spark.createDataFrame([], parts.schema)).schema)
    figures = Kept(spark, f"{path}/figures", velocity.item_figures(spark.createDataFrame([], cube.schema), "item_no").schema)
    return [t.create() for t in (parts, cube, figures)]


def refresh(parts, cube, figures):
    cube.refresh(parts, velocity.by_month)
    return figures.refresh(cube, lambda rows: velocity.item_figures(rows, "item_no"))


def arrived(spark, sf_dir):
    """All sales in three files: the first; the second, which is sent twice; the third, which belongs to the sessions of one year only."""
    sales = b.sales(spark, sf_dir)
    year, first_line = F.floor(F.col("session_id") / 10) + 1990, F.col("row_no") % 10 == 1
    third = (year == LATE) & first_line
    kept = tables(spark, new_folder(spark, "kept"), sales)
    files = {"first": year < LATE, "second": (year >= LATE) & ~third, "again": (year >= LATE) & ~third, "third": third}
    for name, rows in files.items():
        kept[0].append(velocity.by_date(sales.where(rows)), name.replace("again", "second"))
        refresh(*kept)
    return kept


THIRD = f"session_id // 10 + 1990 = {LATE} AND row_no % 10 = 1"


@query("kept_facts", f"""WITH {b.CLEAN} SELECT session_id, count(*) AS n_lines, CAST(sum(qty) AS DOUBLE) AS total_qty, CAST(sum(rev) AS DOUBLE) AS total_revenue, count(DISTINCT month) AS months,
CASE WHEN count(*) FILTER ({THIRD}) BETWEEN 1 AND count(*) - 1 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_refreshed FROM s GROUP BY ALL""")
def kept_facts(spark, sf_dir):
    """Sums by session after all files, and how often each session was computed."""
    _, cube, _ = arrived(spark, sf_dir)
    sums = cube.rows().groupBy("session_id").agg(F.sum("n").alias("n_lines"), F.sum("qty").cast("double").alias("total_qty"), F.sum("revenue").cast("double").alias("total_revenue"), F.count_distinct("month").alias("months"))
    return sums.join(cube.n_refreshed().withColumnRenamed("n", "n_refreshed"), "session_id")


SHAPES = f"""{b.CLEAN}, p AS (SELECT session_id, k, month, CAST(sum(qty) AS DOUBLE) AS q FROM s WHERE month IS NOT NULL GROUP BY ALL),
g AS (SELECT a.session_id, a.k, coalesce(p.q, 0.0) AS q FROM (SELECT DISTINCT session_id, k FROM p) a JOIN (SELECT DISTINCT session_id, month FROM p) mo USING (session_id) LEFT JOIN p USING (session_id, k, month)),
st AS (SELECT session_id, k, count(*) AS n, sum(q) AS total, median(q) AS med, count(*) FILTER (q <= 0) AS zeros, min(q) FILTER (q > 0) AS ls, max(q) FILTER (q > 0) AS hs FROM g GROUP BY ALL),
sh AS (SELECT session_id, k, med, CASE WHEN n < 4 OR total <= 0 THEN 'stable' WHEN zeros * 2 >= n THEN 'lumpy' WHEN med > 0 AND total / n >= 2 * med THEN 'spiky' WHEN med > 0 AND (hs >= 3 * ls OR zeros >= 1) THEN 'volatile' ELSE 'stable' END AS pattern FROM st)"""


@query("kept_figures", f"""WITH {SHAPES}, t AS (SELECT session_id, k, CAST(sum(qty) AS DOUBLE) AS total_qty, CAST(sum(rev) AS DOUBLE) AS total_revenue, count(*) AS n_rows, avg(stated) AS stated_avg FROM s GROUP BY ALL)
SELECT session_id, k AS item_no, total_qty, total_revenue, n_rows, stated_avg, pattern, CASE WHEN pattern = 'spiky' THEN round_even(med, 1) END AS corrected FROM t LEFT JOIN sh USING (session_id, k)""")
def kept_figures(spark, sf_dir):
    """Figures by item after all files, as if all sales had come at once."""
    return arrived(spark, sf_dir)[2].rows().withColumn("corrected", F.bround("corrected", 1))


@query("kept_changes", f"""WITH {b.CLEAN}, t AS (SELECT session_id, k, CAST(sum(qty) FILTER (NOT third) AS DOUBLE) AS qty_before, CAST(sum(qty) AS DOUBLE) AS qty_after, count(*) FILTER (NOT third) AS n_before, count(*) AS n
FROM (SELECT *, {THIRD} AS third FROM s) GROUP BY ALL) SELECT session_id, k AS item_no, CASE WHEN n_before = 0 THEN 'added' ELSE 'changed' END AS change, qty_before, qty_after FROM t WHERE n > n_before""")
def kept_changes(spark, sf_dir):
    """Items whose totals the last file changed."""
    found = arrived(spark, sf_dir)[2].changes(["session_id", "item_no"]).where("NOT before.n_rows <=> after.n_rows")
    return found.select("session_id", "item_no", "change", F.col("before.total_qty").alias("qty_before"), F.col("after.total_qty").alias("qty_after"))
