"""From cells to tables: header rows, column names, wide month grids. A cells table is (file, row_no, col_no, value), non-blank cells only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalars import cell_month, is_total_label, num_cell

# Words of header cells, by kind of table.
HINTS = {
    "inventory": (
        "item", "desc", "product", "sku", "material", "article", "code", "stock", "balance", "on_hand", "qty", "quantity", "uom", "unit", "categ", "class", "supplier", "batch", "expiry", "warehouse",
    ),
    "sales": ("item", "desc", "product", "sku", "code", "qty", "quantity", "amount", "value", "price", "revenue", "date", "invoice", "customer", "uom", "unit"),
}
WINDOW_ROWS = 10


def sanitize(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(F.lower(F.trim(c)), r"[ /-]", "_"), ".()", ""), "[^a-z0-9_]", "")


def header_scores(cells: DataFrame, kind: str) -> DataFrame:
    """file, row_no, filled, score: cells of a row, and those whose text holds a hint word."""
    hit = sanitize(F.col("value")).rlike("|".join(HINTS[kind]))
    return cells.groupBy("file", "row_no").agg(F.count("*").alias("filled"), F.count_if(hit).alias("score"))


def header_rows(cells: DataFrame, kind: str, min_cells: int) -> DataFrame:
    """file, header_row: of the first rows, the first with min_cells cells, unless a later one scores at least two more than the best so
    far; without any, the first later row with three cells. Each task keeps its first rows of a file, so cells are not shuffled for it; those
    of files without a header among them are read once more."""
    first = Window.partitionBy("file").orderBy("row_no")
    top = cells.withColumn("at", F.dense_rank().over(first)).where(F.col("at") <= WINDOW_ROWS)
    scores = header_scores(top, kind)
    rows = scores.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("filled") >= min_cells, F.struct("row_no", "score")))).alias("near"), F.max("row_no").alias("last_near"))
    none_near = rows.where(F.size("near") == 0).select("file", "last_near")
    later = cells.join(none_near, "file").where("row_no > last_near").groupBy("file", "row_no").agg(F.count("*").alias("filled")).where("filled >= 3").groupBy("file").agg(F.min("row_no").alias("later"))
    rows = rows.join(later, "file", "left")
    better = lambda best, x: F.when(best["row_no"].isNull() | (x["score"] >= best["score"] + 2), x).otherwise(best)
    none = F.struct(F.lit(None).cast("bigint").alias("row_no"), F.lit(None).cast("bigint").alias("score"))
    return rows.select("file", F.coalesce(F.aggregate("near", none, better, lambda s: s["row_no"]), F.col("later")).alias("header_row"))


def column_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """file, col_no, name: sanitised header texts, col_<i> where nothing is left, _1, _2, ... behind repeats."""
    h = cells.join(headers, "file").where("row_no = header_row").select("file", "col_no", sanitize(F.col("value")).alias("name"))
    h = h.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("col_"), F.col("col_no").cast("string"))))
    n = F.row_number().over(Window.partitionBy("file", "name").orderBy("col_no")) - 1
    return h.withColumn("n", n).select("file", "col_no", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string"))).alias("name"))


def rows_from_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """file, row_no, cells (map of column name to text) of the rows under the header; cells outside its columns are dropped."""
    below = cells.join(headers, "file").where("row_no > header_row").join(column_names(cells, headers), ["file", "col_no"])
    return below.groupBy("file", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("cells"))


def month_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """file, col_no, month of the header cells that name a month."""
    # exploded, so that the test of the month is not pushed below the join, where it would read every cell of the files
    month = F.explode(F.array(cell_month(F.col("value"))))
    return cells.join(headers, "file").where("row_no = header_row").select("file", "col_no", month.alias("month")).where("month > 0")


def wide_matrix(cells: DataFrame) -> DataFrame:
    """file, wide: whether one of the first 15 rows names six distinct months."""
    n = cells.where("row_no <= 15").withColumn("month", cell_month(F.col("value"))).groupBy("file", "row_no").agg(F.count_distinct(F.when(F.col("month") > 0, F.col("month"))).alias("n"))
    return n.groupBy("file").agg(F.bool_or(F.col("n") >= 6).alias("wide"))


def grid_rows(cells: DataFrame, headers: DataFrame, item_col: int = 1) -> DataFrame:
    """file, row_no, item, month, value: month cells of the item rows; blank names and exact total labels are skipped."""
    months = month_columns(cells, headers)
    named = months.select("file", "col_no", "month").union(headers.select("file", F.lit(item_col).alias("col_no"), F.lit(0).alias("month")))
    body = cells.join(headers, "file").where("row_no > header_row").join(named, ["file", "col_no"])
    # one shuffle brings a row's cells together
    rows = body.groupBy("file", "row_no").agg(F.max(F.when(F.col("month") == 0, F.trim("value"))).alias("item"), F.collect_list(F.when(F.col("month") > 0, F.struct("month", "value"))).alias("cells"))
    rows = rows.where((F.col("item") != "") & ~is_total_label(F.col("item")))
    return rows.select("file", "row_no", "item", F.explode("cells").alias("c")).select("file", "row_no", "item", "c.month", "c.value")


def month_types(grid: DataFrame) -> DataFrame:
    """file, month, n_numbers, n_texts, kind: all texts refuses the file, no cells leaves the month out, a fifth of texts degrades it."""
    n = num_cell(F.col("value")).isNotNull()
    t = grid.groupBy("file", "month").agg(F.count_if(n).alias("n_numbers"), F.count_if(~n).alias("n_texts"))
    kind = F.when((F.col("n_numbers") == 0) & (F.col("n_texts") > 0), "refused").when(F.col("n_numbers") == 0, "empty").when(F.col("n_texts") >= 0.2 * (F.col("n_texts") + F.col("n_numbers")), "mixed").otherwise("good")
    return t.withColumn("kind", kind)


def unpivot_months(grid: DataFrame, year: Column) -> DataFrame:
    """file, item, date (the 15th), qty; cells that are not numbers are skipped, zeros stay."""
    return grid.select("file", "row_no", "item", F.make_date(year, "month", F.lit(15)).alias("date"), num_cell(F.col("value")).alias("qty")).where("qty IS NOT NULL")


def projection_tail(grid: DataFrame) -> DataFrame:
    """file, last_kept: the last month before the longest tail (two months at least, never the first month) in which half of the items
    with numbers throughout, the first of them positive, repeat one value. Walking back stops at the first month whose tail fails."""
    m = grid.select("file", "item", "row_no", "month", num_cell(F.col("value")).alias("q")).where("q IS NOT NULL")
    last = m.groupBy("file").agg(F.max("month").alias("last"), F.min("month").alias("first"))
    ends = Window.partitionBy("file", "row_no", "item").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, 0)
    t = m.join(last, "file").select("*", F.count("*").over(ends).alias("n"), F.min("q").over(ends).alias("low"), F.max("q").over(ends).alias("high"))
    full = (F.col("n") == F.col("last") - F.col("month") + 1) & (F.col("q") > 0)
    ratio = t.groupBy("file", "month", "last", "first").agg((F.count_if(full & (F.col("low") == F.col("high"))) / F.nullif(F.count_if(full), F.lit(0))).alias("ratio"))
    tails = ratio.where("month < last").withColumn("pass", F.coalesce((F.col("ratio") >= 0.5) & (F.col("month") > F.col("first")), F.lit(False)))
    still = Window.partitionBy("file").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("all_pass", F.min("pass").over(still))
    start = tails.where("all_pass").groupBy("file").agg(F.min("month").alias("start"))
    return last.join(start, "file", "left").select("file", F.coalesce(F.col("start") - 1, F.col("last")).alias("last_kept"))


def convert_verify(grid: DataFrame, converted: DataFrame) -> DataFrame:
    """file, month, source, output, agrees: sums of the grid's own numbers and of the converted rows."""
    total = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    a = grid.groupBy("file", "month").agg(total(num_cell(F.col("value"))).alias("source"))
    o = converted.groupBy("file", F.month("date").alias("month")).agg(total(F.col("qty")).alias("output"))
    both = a.join(o, ["file", "month"], "full_outer")
    return both.withColumn("agrees", F.abs(F.coalesce("source", F.lit(0.0)) - F.coalesce("output", F.lit(0.0))) <= 1e-6)


def sheet_pick(cells: DataFrame, kind: str, min_cells: int = 3) -> DataFrame:
    """file, sheet_no: of a workbook's first ten sheets (cells with sheet_no), the first with rows and a header that names at least two
    columns, else the first with a header; a lone sheet needs no such header."""
    sheets = cells.where(f"sheet_no <= {WINDOW_ROWS}").withColumn("book", F.col("file")).withColumn("file", F.concat_ws("\0", "book", "sheet_no"))
    heads = header_rows(sheets, kind, min_cells)
    scores = header_scores(sheets, kind).join(heads, "file").where("row_no = header_row").select("file", "score")
    below = sheets.join(heads, "file").groupBy("file", "book", "sheet_no").agg(F.count_distinct(F.when(F.col("row_no") > F.col("header_row"), F.col("row_no"))).alias("n_rows"))
    n_sheets = cells.groupBy(F.col("file").alias("book")).agg(F.count_distinct("sheet_no").alias("n_sheets"))
    ranked = below.join(scores, "file").join(n_sheets, "book").withColumn("sure", (F.col("n_sheets") == 1) | ((F.col("n_rows") > 0) & (F.col("score") >= 2)))
    return ranked.groupBy("book").agg(F.min_by("sheet_no", F.struct(~F.col("sure"), "sheet_no")).alias("sheet_no")).withColumnRenamed("book", "file")


MIN_MONTHS = 6


def recipe_refusals(recipes: DataFrame) -> DataFrame:
    """file, reasons (none: the recipe holds) of layout recipes (file, layout, header_row, item_col, month_cols map<int,int>, supplier_col,
    leadtime_col) over files of n_rows and n_cols."""
    months = F.coalesce("month_cols", F.create_map().cast("map<int,int>"))
    columns, numbers = F.map_keys(months), F.transform(F.array_sort(F.map_entries(months)), lambda e: e["value"])
    inside = lambda c, top: F.col(c).between(1, F.col(top))
    others = F.array_compact(F.array("item_col", "supplier_col", "leadtime_col"))
    checks = {
        "unsupported layout": F.coalesce(F.col("layout") != "wide_matrix", F.lit(True)),
        "header row out of bounds": ~F.coalesce(inside("header_row", "n_rows"), F.lit(False)),
        "item column out of bounds": ~F.coalesce(inside("item_col", "n_cols"), F.lit(False)),
        "supplier column out of bounds": ~F.coalesce(inside("supplier_col", "n_cols"), F.lit(True)),
        "lead-time column out of bounds": ~F.coalesce(inside("leadtime_col", "n_cols"), F.lit(True)),
        "too few months": F.size(months) < MIN_MONTHS,
        "month column out of bounds": F.exists(columns, lambda c: ~c.between(1, F.col("n_cols"))),
        "month number invalid": F.exists(numbers, lambda m: m.isNull() | ~m.between(1, 12)),
        "month number repeated": F.size(F.array_distinct(numbers)) < F.size(numbers),
        "months not in calendar order": numbers != F.array_sort(numbers),
        "columns collide": F.arrays_overlap(columns, others) | (F.size(F.array_distinct(others)) < F.size(others)),
    }
    return recipes.select("file", F.array_compact(F.array(*[F.when(c, reason) for reason, c in checks.items()])).alias("reasons"))


def borderline(grid: DataFrame, kept: DataFrame) -> DataFrame:
    """file, borderline: whether the first dropped month (after last_kept) has own values in at least a tenth of the items that have numbers
    in it (positive) and in the next month: then it was real."""
    m = grid.join(kept, "file").where("month BETWEEN last_kept + 1 AND last_kept + 2").select("file", "row_no", F.col("month") - F.col("last_kept"), num_cell(F.col("value")).alias("q")).toDF("file", "row_no", "at", "q")
    two = m.groupBy("file", "row_no").agg(F.max(F.when(F.col("at") == 1, F.col("q"))).alias("b"), F.max(F.when(F.col("at") == 2, F.col("q"))).alias("n")).where("b > 0 AND n IS NOT NULL")
    found = two.groupBy("file").agg((F.count_if(F.col("b") == F.col("n")) < 0.9 * F.count("*")).alias("borderline"))
    return kept.select("file").join(found, "file", "left").select("file", F.coalesce("borderline", F.lit(False)).alias("borderline"))


def assumed_year(last_month: Column, as_of: Column) -> Column:
    """The year of a grid that states none: last year's, if its last real month has not come yet."""
    return F.year(as_of) - F.when(last_month > F.month(as_of), 1).otherwise(0)


def json_rows(blobs: DataFrame, kind: str) -> DataFrame:
    """blobs (id, text) as rows of their arrays of objects (DDL kind); null, empty and malformed texts give none, {"report": [...]} is
    unwrapped, elements that are no objects are skipped."""
    json = F.when(F.try_parse_json("text").isNotNull(), F.col("text"))
    inner = F.when(F.trim(json).startswith("{"), F.get_json_object(json, "$.report")).otherwise(json)
    items = F.from_json(inner, "array<string>")
    return blobs.select("id", F.posexplode(items).alias("pos", "one")).where(F.trim("one").startswith("{")).select("id", "pos", F.from_json("one", kind).alias("o")).select("id", "pos", "o.*")


def reply_rows(replies: DataFrame, kind: str) -> DataFrame:
    """id, items (array of DDL kind; null: nothing readable), repaired of replies (id, text): a code fence is dropped, the outermost [...] is
    read; a list that was cut short is closed after its last complete object."""
    s = F.trim("text")
    fenced = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\s*```$", "")
    bare = F.when(s.startswith("```"), fenced).otherwise(s)
    start = F.instr(bare, "[")
    body = F.when(start > 0, F.substring(bare, start, F.length(bare)))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    whole = valid(F.regexp_extract(body, r"(?s)^\[.*\]", 0))
    cut = lambda end: valid(F.concat(F.regexp_extract(body, rf"(?s)^(\[.*\}}){end}", 1), F.lit("]")))
    repaired = F.coalesce(cut(","), cut(""))
    json = F.coalesce(F.nullif(whole, F.lit("")), repaired)
    return replies.select("id", F.from_json(json, f"array<{kind}>").alias("items"), (F.nullif(whole, F.lit("")).isNull() & repaired.isNotNull()).alias("repaired"))
