"""Column roles over eight header styles, one file for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import roles as r
from shelfspark.sources import bindings as b

from .register import Register

REGISTER = query = Register()
STYLES = [
    ["item_code", "qty_sold", "item_description", "qty_on_hand", "uom", "net_amount", "invoice_date", "supplier_name"],
    ["supplier_desc", "product_name", "current_stock_value", "stock_left", "unit_of_sale", "product_class", "avg_qty___month", "delivery_date", "sales_value_total"],
    ["desc", "sales_qty", "qty_left", "storage", "vendor", "qty_per_month", "unit_price"],
    ["description", "qty_allocated", "quantity", "cat", "month_period", "revenue", "date", "name"],
    ["item", "billing_qty", "balance", "unit", "avg_amount_month", "amount", "supplier"],
    ["stock_description", "current_system_balance", "category", "base_uom", "mth_average", "order_qty", "price_list", "type"],
    ["code", "qty_on_order", "total"],
    ["inventory_desc", "qty_sold", "allocated_qty", "on_hand_price", "supplier_code", "supplier_name", "supplier_class", "unit_cost"],
]
COLS = "c AS (SELECT CAST(p_partkey AS BIGINT) AS file, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STYLES)) + " END AS cols FROM part)"


def columns(spark, sf_dir):
    """file, col_no, name."""
    files = b.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("file"))
    names = F.get(F.array(*[F.array(*map(F.lit, s)) for s in STYLES]), (F.col("file") % 8).cast("int"))
    return b.large(files.select("file", F.posexplode(names).alias("col_no", "name")))


def _sql_rule(rule):
    kind, words, without = rule
    has = lambda ws, how: f" {how} ".join(f"contains(x, '{w}')" for w in ws) or "false"
    if kind == "average":
        found = "(contains(x, 'month') OR contains(x, 'mth')) AND (contains(x, 'avg') OR contains(x, 'average') OR contains(x, 'mean') OR list_contains(string_split_regex(x, '[^a-z]+'), 'per'))"
    else:
        found = f"list_contains({list(words)}, x)" if kind == "exact" else has(words, "OR" if kind == "any" else "AND")
    return f"list_filter(cols, lambda x: ({found}) AND NOT ({has(without, 'OR')}))[1]"


def pick_sql(rules):
    return f"WITH {COLS} SELECT file, " + ", ".join(f"coalesce({', '.join(map(_sql_rule, p))}) AS {role}" for role, p in rules.items()) + " FROM c"


@query("role_stock", pick_sql({"stock": r.INVENTORY["stock"]}))
def role_stock(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), {"stock": r.INVENTORY["stock"]})


@query("role_inventory", pick_sql(r.INVENTORY))
def role_inventory(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.INVENTORY)


@query("role_sales", pick_sql(r.SALES))
def role_sales(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.SALES)


@query("role_scope", pick_sql(r.SCOPE).replace("SELECT file, ", "SELECT *, coalesce(revenue, quantity) AS metric FROM (SELECT file, ").replace(" FROM c", " FROM c)"))
def role_scope(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.SCOPE).withColumn("metric", F.coalesce("revenue", "quantity"))


@query("role_avg_month", pick_sql(r.AVERAGE))
def role_avg_month(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.AVERAGE)


@query("role_supplier", pick_sql(r.SUPPLIER))
def role_supplier(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.SUPPLIER)


@query("role_dq_sales", pick_sql(r.GATE))
def role_dq_sales(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.GATE)


@query("role_item_names", pick_sql(r.NAMES))
def role_item_names(spark, sf_dir):
    return r.roles(columns(spark, sf_dir), r.NAMES)


@query("stock_column_suspect", f"SELECT file, 'WARN' AS level, 'stock_column_suspect' AS code FROM ({pick_sql({'stock': r.INVENTORY['stock']})}) WHERE " + " OR ".join(f"contains(stock, '{w}')" for w in r.SUSPECT_STOCK))
def stock_column_suspect(spark, sf_dir):
    """The gate's finding about a stock column whose name suggests another figure."""
    found = r.roles(columns(spark, sf_dir), {"stock": r.INVENTORY["stock"]})
    return found.where(r.holds(F.col("stock"), ("any", r.SUSPECT_STOCK, ()))).select("file", F.lit("WARN").alias("level"), F.lit("stock_column_suspect").alias("code"))


@query("no_columns", f"SELECT file, 'BLOCK' AS level, 'no_columns' AS code FROM ({pick_sql(r.INVENTORY)}) WHERE stock IS NULL OR description IS NULL")
def no_columns(spark, sf_dir):
    """The gate's finding about files without a name or a stock column."""
    found = r.roles(columns(spark, sf_dir), r.INVENTORY)
    return found.where("stock IS NULL OR description IS NULL").select("file", F.lit("BLOCK").alias("level"), F.lit("no_columns").alias("code"))


@query("role_override", f"""WITH {COLS}, p AS ({pick_sql(r.INVENTORY)}), q AS (SELECT c.file, cols, stock, description, CASE c.file % 5 WHEN 0 THEN 'qty_sold' WHEN 1 THEN 'qty_left' WHEN 2 THEN 'missing' WHEN 3 THEN 'quantity' END AS s, CASE c.file % 3 WHEN 0 THEN 'item_code' WHEN 1 THEN 'name' END AS d FROM c JOIN p USING (file))
SELECT file, 'stock' AS role, CASE WHEN list_contains(cols, s) AND s <> 'qty_sold' AND file % 7 <> 0 THEN s ELSE stock END AS name FROM q UNION ALL SELECT file, 'description', CASE WHEN list_contains(cols, d) THEN d ELSE description END FROM q""")
def role_override(spark, sf_dir):
    """Proposals for two roles; every seventh file's columns are not numeric."""
    cols = columns(spark, sf_dir)
    picked = r.roles(cols, r.INVENTORY).unpivot("file", ["stock", "description"], "role", "name")
    k = F.col("file")
    stock = F.when(k % 5 == 0, "qty_sold").when(k % 5 == 1, "qty_left").when(k % 5 == 2, "missing").when(k % 5 == 3, "quantity")
    name = F.when(k % 3 == 0, "item_code").when(k % 3 == 1, "name")
    proposals = cols.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit("stock").alias("role"), stock.alias("proposed")), F.struct(F.lit("description").alias("role"), name.alias("proposed")))).alias("p")).select("file", "p.*")
    numeric = r.looks_numeric(cols.withColumn("value", F.when(k % 7 == 0, "none").otherwise("12 CTN")), ["file", "name"])
    return r.override(picked, cols, proposals, numeric)


@query("looks_numeric", f"""WITH {b.CLEAN}, x AS (SELECT session_id, count(stated) > 0 AS has_avg, count(month) > 0 AS dated FROM s GROUP BY ALL)
SELECT session_id, 'qty_raw' AS name, true AS numeric FROM x UNION ALL SELECT session_id, 'item_raw', false FROM x UNION ALL SELECT session_id, 'avg_raw', has_avg FROM x UNION ALL SELECT session_id, 'date_raw', dated AND session_id // 10 % 4 = 0 FROM x""")
def looks_numeric(spark, sf_dir):
    """Of four columns of the sales sheets: only quantities, averages and serial dates do (1990 + session_id / 10 is the year)."""
    names = ["qty_raw", "item_raw", "avg_raw", "date_raw"]
    cells = b.sales(spark, sf_dir).select("session_id", *names).unpivot("session_id", names, "name", "value")
    return r.looks_numeric(cells, ["session_id", "name"])
