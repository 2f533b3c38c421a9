"""Which column plays which role: rules over header names, all roles of all files in one aggregation.

A rule list is tried in order; within a rule the first column in sheet order wins. A rule is (kind, words, excluded words): `exact` names,
names that contain `any` or `all` of the words, or a stated monthly `average`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import to_num

# Header names and words of each role.
DESCRIPTIONS = ("description", "item_description", "inventory_desc", "product_description", "item_name", "product_name", "stock_description", "item_desc")
CATEGORIES = ("category", "cat", "class", "item_category", "product_category", "storage_type")
UNITS = ("uom", "unit_of_measure", "unit", "uom_code", "uom_description", "base_uom", "purchase_uom", "sales_uom", "stock_uom")
STOCKS = (
    "qty_on_hand", "qty", "quantity", "stock_on_hand", "on_hand", "stock_qty", "balance", "stock_balance", "closing_stock", "current_system_balance", "system_balance", "current_balance", "current_stock",
)
NOT_STOCK = ("sold", "sale", "avg", "allocated", "value", "amount", "price")
SUSPECT_STOCK = ("on_order", "onorder", "allocated", "reserved", "back_order", "backorder", "sold", "qty_sold")
SOLD_NAMES = ("inventory_desc", "item_description", "description", "product_name")
SOLD_QUANTITIES = ("billing_qty", "qty", "quantity", "billing_quantity")
REVENUES = ("net_amount", "total_amount", "amount", "billing_amount", "sales_value", "net_value", "total_value", "revenue", "ext_price")
SCOPE_REVENUES = (
    "net_amount", "total_amount", "amount", "value", "billing_amount", "sales_value", "net_value", "total_value", "revenue", "ext_price", "unit_price", "price", "sales_amount", "invoice_amount",
)
SCOPE_QUANTITIES = ("billing_qty", "qty", "quantity", "billing_quantity", "order_qty", "sales_qty", "shipped_qty")
DATES = ("date", "invoice_date", "order_date", "transaction_date", "sales_date", "po_date", "doc_date", "posting_date")
MONEY = ("amount", "value", "revenue", "price", "$")
ITEM_NAMES = ("description", "item_description", "inventory_desc", "item_name", "product_description", "product_name")

Rules = dict[str, list[tuple[str, tuple, tuple]]]
_MONEY_WORDS = ("amount", "value", "revenue", "price")
INVENTORY: Rules = {
    "description": [("exact", DESCRIPTIONS, ()), ("any", ("desc", "item_name", "product_name"), ("supplier",))],
    "stock": [("exact", STOCKS, ()), ("any", ("balance", "on_hand", "stock"), NOT_STOCK), ("any", ("qty", "quantity"), NOT_STOCK)],
    "category": [("exact", CATEGORIES, ()), ("any", ("cat", "class", "storage"), ())],
    "uom": [("exact", UNITS, ()), ("any", ("uom", "unit_of"), ())],
}
_SOLD_NAME = [("exact", SOLD_NAMES, ()), ("any", ("desc", "item_name", "product_name", "item"), ("supplier",))]
SALES: Rules = {
    "description": _SOLD_NAME,
    "quantity": [("exact", SOLD_QUANTITIES, ()), ("any", ("qty", "quantity"), ("allocated",))],
    "revenue": [("exact", REVENUES, ()), ("any", _MONEY_WORDS, ())],
    "date": [("exact", DATES, ()), ("any", ("date",), ())],
}
SCOPE: Rules = {
    "description": _SOLD_NAME,
    "revenue": [("exact", SCOPE_REVENUES, ()), ("any", _MONEY_WORDS, ())],
    "quantity": [("exact", SCOPE_QUANTITIES, ()), ("any", ("qty", "quantity"), ())],
}
AVERAGE: Rules = {"avg_month": [("average", (), MONEY)]}
SUPPLIER: Rules = {
    "po_supplier": [("all", ("supplier", "name"), ()), ("any", ("supplier",), ())],
    "listing_name": [("any", ("name", "supplier"), ())],
    "listing_type": [("any", ("type", "category", "class"), ())],
    "sales_supplier": [("any", ("supplier", "vendor"), ())],
}
GATE: Rules = {
    "description": [("exact", SOLD_NAMES, ()), ("any", ("desc", "item", "product"), ("supplier",))],
    "quantity": [("exact", ("qty", "quantity", "qty_sold", "billing_qty"), ()), ("any", ("qty", "quantity"), ())],
    "unit": [("exact", ("unit", "uom"), ()), ("any", ("unit",), ())],
}
NAMES: Rules = {"item_name": [("exact", (n,), ()) for n in ITEM_NAMES]}


def _has(name: Column, words: tuple, how) -> Column:
    return reduce(how, [name.contains(w) for w in words], F.lit(how is _and))


def _or(a: Column, b: Column) -> Column:
    return a | b


def _and(a: Column, b: Column) -> Column:
    return a & b


def holds(name: Column, rule: tuple) -> Column:
    """Whether a header name follows a rule."""
    kind, words, without = rule
    if kind == "average":  # a month, and an average or the word `per`
        low = F.lower(name)
        means = _has(low, ("avg", "average", "mean"), _or) | F.array_contains(F.split(low, "[^a-z]+"), "per")
        found = _has(low, ("month", "mth"), _or) & means
    else:
        found = name.isin(*words) if kind == "exact" else _has(name, words, _or if kind == "any" else _and)
    return found & ~_has(name, without, _or)


def roles(columns: DataFrame, rules: Rules) -> DataFrame:
    """file and, for each role, the name of its column (null: none), from columns (file, col_no, name)."""

    def pick(passes: list) -> Column:
        rank = reduce(lambda w, x: w.when(holds(F.col("name"), x[1]), x[0]), enumerate(passes), F.when(F.lit(False), -1))
        return F.min_by(F.when(rank.isNotNull(), F.col("name")), F.when(rank.isNotNull(), F.struct(rank, "col_no")))

    return columns.groupBy("file").agg(*[pick(p).alias(role) for role, p in rules.items()])


def looks_numeric(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, numeric: whether at least half (rounded down, one at least) of the non-blank cells are numbers."""
    seen, n = F.count_if(F.trim(value) != ""), F.count_if((F.trim(value) != "") & to_num(F.col(value)).isNotNull())
    return cells.groupBy(*keys).agg(((seen > 0) & (n >= F.greatest(F.lit(1), F.floor(seen / 2)))).alias("numeric"))


def override(picked: DataFrame, columns: DataFrame, proposals: DataFrame, numeric: DataFrame) -> DataFrame:
    """picked (file, role, name) with proposals (file, role, proposed) where they hold: the column exists, and a stock column has no excluded
    word and looks numeric (file, name, numeric)."""
    known = columns.select("file", F.col("name").alias("proposed"), F.lit(True).alias("known"))
    j = picked.join(proposals, ["file", "role"], "left").join(known, ["file", "proposed"], "left").join(numeric.withColumnRenamed("name", "proposed"), ["file", "proposed"], "left")
    stock_ok = (F.col("role") != "stock") | (~_has(F.col("proposed"), NOT_STOCK, _or) & F.coalesce("numeric", F.lit(False)))
    return j.select("file", "role", F.when(F.col("known") & stock_ok, F.col("proposed")).otherwise(F.col("name")).alias("name"))
