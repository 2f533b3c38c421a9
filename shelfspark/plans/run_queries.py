"""A whole analysis run: names by the alias table, scope, suppliers from the sales sheet where no order names one, shapes by canonical name."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.scalars import match_key
from shelfspark.operators import decisions, names, reports, suppliers, velocity
from shelfspark.operators.durable import durable
from shelfspark.operators.ordered import Number, in_order
from shelfspark.sources import bindings as b

from .analysis import METRICS_SQL, ORDER_STATUS_SQL, stock_rows
from .register import Register

REGISTER = query = Register()

ALIASED, UNORDERED, SCOPED, TOP = 41, 13, 3, 20


def sales(spark, sf_dir):
    """Sales in which every ALIASED-th item goes under a product name that the stock sheet does not know."""
    return b.sales(spark, sf_dir).withColumn("item_raw", F.when(F.col("item_no") % ALIASED == 0, F.concat(F.lit("Catalogue product "), F.col("item_no").cast("string"))).otherwise(F.col("item_raw")))


def with_canonical(rows, spark, sf_dir):
    """rows with `canonical` by the alias table, which leads from the stock sheet's names of these items to the product names."""
    k = F.col("row_no")
    alias = b.inventory(spark, sf_dir).where(k % ALIASED == 0).select("session_id", F.upper("item").alias("variant"), F.concat(F.lit("Catalogue product "), k.cast("string")).alias("canonical"))
    return names.canonical(rows, alias)


def in_scope(rows, keyed):
    """Every SCOPED-th session looks at its TOP items by revenue only; of equal ones, those that come first on the stock sheet."""
    scoped = F.col("session_id") % SCOPED == 0
    totals = keyed.where(scoped).groupBy("session_id", "key").agg(F.sum("revenue").alias("r"))
    places = rows.where(scoped).groupBy("session_id", match_key(F.col("canonical")).alias("key")).agg(F.min("row_no").alias("place"))
    totals = totals.join(places, ["session_id", "key"], "left")
    top = in_order(totals, ["session_id"], [F.desc("r"), F.col("place").asc_nulls_last(), "key"], {"rank": Number()}).where(F.col("rank") <= TOP).select("session_id", "key")
    return names.in_scope(rows.where(scoped), top).unionByName(rows.where(~scoped))


def named(facts, stock):
    """What the sales names stand for among the stock sheet's canonical names."""
    return b.large(durable(names.match_names(facts.select("session_id", F.col("item_raw").alias("name")), stock), "names"))


def shapes_of(facts, matched):
    """The demand shape of each sales name as it stands."""
    return velocity.demand_shapes(velocity.monthly_vectors(velocity.raw_key(facts, matched))).select("session_id", "key", "pattern", "corrected")


def run(spark, sf_dir):
    """One row for each (session, item) in scope, with everything that an order is decided on."""
    facts = velocity.sales_cube(sales(spark, sf_dir))
    stock = with_canonical(b.inventory(spark, sf_dir), spark, sf_dir).select("session_id", F.col("canonical").alias("item"))
    matched = named(facts, stock)
    keyed = velocity.with_keys(facts, matched)
    speed = b.large(durable(velocity.sales_velocity(keyed, ["session_id", "key"]), "speed"))
    months = velocity.months_resolved(velocity.months_covered(facts), velocity.months_inferred(speed))
    shapes = b.large(durable(shapes_of(facts, matched), "shapes"))

    rows = durable(in_scope(with_canonical(stock_rows(spark, sf_dir).drop("n_rows"), spark, sf_dir), keyed), "stock")
    rows = rows.withColumnRenamed("key", "own_key").withColumn("key", match_key(F.col("canonical")))
    rows = rows.join(speed, ["session_id", "key"], "left").join(months, "session_id", "left")
    rows = velocity.with_shape(rows, shapes)
    spiky = F.when(F.col("pattern") == "spiky", F.bround("corrected", 1))
    rows = rows.withColumn("avg_monthly", velocity.avg_monthly(F.col("stated_avg"), spiky, F.col("total_qty"), F.coalesce("months", F.lit(velocity.ASSUMED_MONTHS))))

    orders = b.purchase_orders(spark, sf_dir).where(F.substring_index("item", " ", -1).cast("int") % UNORDERED != 1)
    latest = suppliers.latest_supplier(orders, ["org_name", "item"]).withColumnRenamed("supplier", "ordered_from")
    sheet = suppliers.sheet_supplier(velocity.with_keys(sales(spark, sf_dir), matched)).withColumnRenamed("supplier", "on_sheet")
    rows = rows.join(latest, ["org_name", "item"], "left").join(sheet, ["session_id", "key"], "left").withColumn("supplier", F.coalesce("ordered_from", "on_sheet"))
    rows = rows.join(suppliers.lead_times(b.supplier_profiles(spark, sf_dir)), "supplier", "left")

    rows = rows.withColumn("months_of_supply", decisions.months_of_supply(F.col("stock"), F.col("avg_monthly"))).withColumn("lead_months", F.bround(F.col("lead_days") / 30, 1))
    rows = rows.withColumn("status", decisions.final_status(*[F.col(c) for c in ("months_of_supply", "lead_months", "stock", "total_qty")]))
    rows = rows.withColumn("buffer_days", decisions.buffer_days(F.bround(F.col("months_of_supply") * 30, 0), F.col("lead_days"))).withColumn("order_status", decisions.order_status(F.col("buffer_days")))
    return rows.withColumn("suggested", decisions.suggested_quantity(F.col("avg_monthly"), F.col("lead_days"), F.coalesce("delay", F.lit(0.2))))


RUN_SQL = METRICS_SQL
for _old, _new in (
    ("i.k % 11 = 0 AS cut, i.k % 11 <> 0 AND i.k % 7 = 0 AS noted", f"i.k % {ALIASED} <> 0 AND i.k % 11 = 0 AS cut, i.k % {ALIASED} <> 0 AND i.k % 11 <> 0 AND i.k % 7 = 0 AS noted"),
    ("count(*) AS n FROM item GROUP BY ALL)", f"count(*) AS n FROM item WHERE k % {ALIASED} <> 0 GROUP BY ALL)"),
    ("x1 AS (SELECT", f"""ordered AS (SELECT k, s_name AS supplier FROM po JOIN supplier ON s_suppkey = sk WHERE k % {UNORDERED} <> 1),
sheet AS (SELECT session_id, k, min(supplier) AS supplier FROM m GROUP BY ALL HAVING count(DISTINCT supplier) = 1),
top AS (SELECT session_id, k FROM (SELECT session_id, k, sum(rev) AS r FROM m WHERE session_id % {SCOPED} = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r DESC, k) <= {TOP}),
x1 AS (SELECT"""),
    ("LEFT JOIN po USING (k) LEFT JOIN pro ON pro.sk = po.sk)", f"""LEFT JOIN ordered USING (k) LEFT JOIN sheet USING (session_id, k) LEFT JOIN pro ON pro.supplier = coalesce(ordered.supplier, sheet.supplier)
       LEFT JOIN top USING (session_id, k) WHERE session_id % {SCOPED} <> 0 OR top.k IS NOT NULL)"""),
):
    assert _old in RUN_SQL
    RUN_SQL = RUN_SQL.replace(_old, _new)
RUN_SQL = RUN_SQL.replace("top AS (SELECT session_id, k FROM (", "top AS (SELECT session_id, k, true AS in_top FROM (").replace("OR top.k IS NOT NULL", "OR in_top")


@query("run_metrics", f"WITH {RUN_SQL} SELECT session_id, item, stock, total_qty, months, avg_monthly, mos AS months_of_supply, supplier, lead_days, status, suggested FROM met")
def run_metrics(spark, sf_dir):
    return run(spark, sf_dir).select("session_id", b.shown("item").alias("item"), "stock", "total_qty", "months", "avg_monthly", "months_of_supply", "supplier", "lead_days", "status", "suggested")


@query("run_orders", f"""WITH {RUN_SQL}, recs AS (SELECT *, {ORDER_STATUS_SQL} AS order_status FROM met WHERE status IN ('LOW', 'CRITICAL') AND suggested > 0),
g AS (SELECT *, coalesce(supplier, 'Unknown supplier') AS shown, count(*) FILTER (status = 'CRITICAL') OVER w AS crit, count(*) OVER w AS n FROM recs WINDOW w AS (PARTITION BY session_id, coalesce(supplier, 'Unknown supplier')))
SELECT session_id, shown AS supplier, item, status, stock, suggested AS quantity, buffer AS buffer_days, order_status,
row_number() OVER (PARTITION BY session_id ORDER BY crit DESC, n DESC, lower(shown), shown, CASE order_status WHEN 'overdue' THEN 0 WHEN 'urgent' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END, buffer ASC NULLS LAST, CASE status WHEN 'CRITICAL' THEN 0 ELSE 1 END, k) AS display_number FROM g""")
def run_orders(spark, sf_dir):
    """What to reorder, how much, from whom and by when, numbered like the order sheet that a customer prints."""
    recs = run(spark, sf_dir).where("status IN ('LOW', 'CRITICAL') AND suggested > 0").withColumnRenamed("row_no", "pos")
    recs = recs.withColumns({"error": F.lit(False), "edited_supplier": F.lit(None).cast("string"), "edited_quantity": F.lit(None).cast("string")})
    return reports.display_order(recs).select("session_id", F.col("eff_supplier").alias("supplier"), b.shown("item").alias("item"), "status", "stock", F.col("suggested").alias("quantity"), "buffer_days", "order_status", "display_number")


@query("pattern_lookup", f"WITH {RUN_SQL} SELECT session_id, item.item, corrected FROM spk JOIN item USING (k)")
def pattern_lookup(spark, sf_dir):
    """Spiky items with the median that sizing uses: a stock item finds its shape by its canonical name, else by its own."""
    inv = with_canonical(b.inventory(spark, sf_dir), spark, sf_dir).select("session_id", "item", match_key(F.col("canonical")).alias("key"), match_key(F.col("item")).alias("own_key"))
    facts = velocity.sales_cube(sales(spark, sf_dir))
    stock = with_canonical(b.inventory(spark, sf_dir), spark, sf_dir).select("session_id", F.col("canonical").alias("item"))
    found = velocity.with_shape(inv, b.large(durable(shapes_of(facts, named(facts, stock)), "shapes")))
    return found.where("pattern = 'spiky'").select("session_id", b.shown("item").alias("item"), F.bround("corrected", 1).alias("corrected"))
