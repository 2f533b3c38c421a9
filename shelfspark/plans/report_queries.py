"""Report queries over recommendations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import decisions, reports
from shelfspark.operators.durable import durable, new_folder
from shelfspark.operators.ordered import Number, in_order, plain
from shelfspark.sources import bindings as b
from shelfspark.sources import sinks

from .register import Register

REGISTER = query = Register()


def as_of():
    return F.lit("2001-12-31").cast("date")


BASE = f"WITH {b.RECS_SQL}, ok AS (SELECT * FROM rec WHERE NOT error)"
EFF = f"""{BASE}, e AS (SELECT *, CASE WHEN edited_supplier <> '' THEN edited_supplier ELSE coalesce(supplier, 'Unknown supplier') END AS eff_supplier,
CASE WHEN edited_quantity <> 'null' THEN edited_quantity ELSE CAST(suggested AS VARCHAR) END AS eff_quantity,
CAST(round_even(days_of_supply - lead_days, 0) AS INTEGER) AS buffer_days FROM ok),
d AS (SELECT *, CASE WHEN buffer_days < 0 THEN 'overdue' WHEN buffer_days <= 7 THEN 'urgent' WHEN buffer_days IS NOT NULL THEN 'ok' ELSE 'unknown' END AS order_status FROM e),
gr AS (SELECT *, count(*) FILTER (status = 'CRITICAL') OVER w AS gc, count(*) OVER w AS gn FROM d WINDOW w AS (PARTITION BY session_id, eff_supplier)),
num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY gc DESC, gn DESC, lower(eff_supplier), eff_supplier, CASE order_status WHEN 'overdue' THEN 0 WHEN 'urgent' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END,
buffer_days ASC NULLS LAST, CASE status WHEN 'CRITICAL' THEN 0 WHEN 'LOW' THEN 1 ELSE 2 END, pos) AS display_number FROM gr)"""


def recs(spark, sf_dir):
    return b.recommendations(spark, sf_dir)


NOTE = '''CASE WHEN pos % 7 = 0 THEN '=ask ' || item WHEN pos % 7 = 1 THEN 'say "now", later ' END'''


def numbered(spark, sf_dir):
    return reports.display_order(reports.with_order_by(recs(spark, sf_dir).withColumn("note", F.expr(NOTE)), as_of()))


@query("order_by", f"""{EFF} SELECT session_id, pos, buffer_days, order_status, CASE WHEN buffer_days IS NOT NULL THEN DATE '2001-12-31' + buffer_days END AS order_by,
CASE WHEN order_status IN ('overdue', 'urgent') THEN 'ASAP' WHEN order_status = 'ok' THEN strftime(DATE '2001-12-31' + buffer_days, '%d %b %Y') ELSE '—' END AS order_text FROM d""")
def order_by(spark, sf_dir):
    return reports.with_order_by(reports.valid(recs(spark, sf_dir)), as_of()).select("session_id", "pos", "buffer_days", "order_status", "order_by", "order_text")


@query("supplier_groups", f"{EFF} SELECT session_id, eff_supplier AS supplier, count(*) AS n, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'LOW') AS low, arg_min(risk, pos) AS first_risk, list_sort(list(DISTINCT item)) AS items FROM e GROUP BY ALL")
def supplier_groups(spark, sf_dir):
    return reports.supplier_groups(recs(spark, sf_dir))


@query("display_number", f"{EFF} SELECT session_id, pos, eff_supplier, display_number FROM num")
def display_number(spark, sf_dir):
    return numbered(spark, sf_dir).select("session_id", "pos", "eff_supplier", "display_number")


@query("group_sort", f"{EFF} SELECT session_id, eff_supplier AS supplier, min(display_number) AS first_number, max(display_number) AS last_number FROM num GROUP BY ALL")
def group_sort(spark, sf_dir):
    return numbered(spark, sf_dir).groupBy("session_id", F.col("eff_supplier").alias("supplier")).agg(F.min("display_number").alias("first_number"), F.max("display_number").alias("last_number"))


@query("urgency_sort", f"""{EFF} SELECT session_id, pos, row_number() OVER (PARTITION BY session_id ORDER BY CASE order_status WHEN 'overdue' THEN 0 WHEN 'urgent' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END, buffer_days ASC NULLS LAST,
CASE status WHEN 'CRITICAL' THEN 0 WHEN 'LOW' THEN 1 ELSE 2 END, pos) AS place FROM d""")
def urgency_sort(spark, sf_dir):
    rows = reports.with_order_by(reports.valid(recs(spark, sf_dir)), as_of())
    return in_order(rows, ["session_id"], reports.urgency(), {"place": Number()}).select("session_id", "pos", "place")


SHEET = """session_id, item, stock, CASE WHEN eff_quantity <> CAST(suggested AS VARCHAR) THEN eff_quantity || ' (AI: ' || suggested || ')' ELSE eff_quantity END AS quantity, eff_supplier AS supplier,
CASE WHEN order_status IN ('overdue', 'urgent') THEN 'ASAP' WHEN order_status = 'ok' THEN strftime(DATE '2001-12-31' + buffer_days, '%d %b %Y') ELSE '—' END AS order_text,
round_even(days_of_supply / 30, 1) AS runway_months, CASE WHEN CAST(eff_quantity AS DOUBLE) > 0 AND avg_monthly > 0 THEN round_even(CAST(eff_quantity AS DOUBLE) / avg_monthly, 1) END AS lasts_months,
CASE WHEN pos % 7 = 0 THEN '''=ask ' || item WHEN pos % 7 = 1 THEN 'say "now", later ' END AS notes"""
SHEET_SCHEMA = "item string, stock double, quantity string, supplier string, order_text string, runway_months double, lasts_months double, notes string"


@query("order_sheet_export", f"{EFF} SELECT {SHEET} FROM num WHERE approved")
def order_sheet_export(spark, sf_dir):
    """Approved orders as CSV files of each session, read back; the export is run twice and stays the same."""
    path = new_folder(spark, "orders")
    sheet = durable(reports.order_sheet_rows(numbered(spark, sf_dir).where("approved")), "sheet")
    for _ in range(2):
        sinks.write_csv(sheet, path, reports.LABELS, ["display_number"])
    return sinks.read_csv(spark, path, f"{SHEET_SCHEMA}, session_id long")


@query("print_sheet", f"{EFF} SELECT {SHEET}, approved FROM num")
def print_sheet(spark, sf_dir):
    """All orders with their approval, as CSV files of each session, read back."""
    path, rows = new_folder(spark, "print"), numbered(spark, sf_dir)
    sheet = reports.order_sheet_rows(rows, "approved")
    sinks.write_csv(sheet, path, reports.LABELS | {"approved": "Approved"}, ["display_number"])
    return sinks.read_csv(spark, path, f"{SHEET_SCHEMA}, approved boolean, session_id long")


@query("clarity_gaps", f"""{EFF}, c AS (SELECT session_id, count(*) FILTER (lead_days IS NULL) AS no_lead_time, count(*) FILTER (lower(eff_supplier) IN ('unknown', 'unknown supplier')) AS unknown_supplier,
count(*) FILTER (pattern <> 'stable') AS unusual_pattern FROM e GROUP BY ALL)
SELECT * FROM (SELECT session_id, 'no_lead_time' AS gap, no_lead_time AS n FROM c UNION ALL SELECT session_id, 'unknown_supplier', unknown_supplier FROM c UNION ALL SELECT session_id, 'unusual_pattern', unusual_pattern FROM c) WHERE n > 0""")
def clarity_gaps(spark, sf_dir):
    return reports.clarity_gaps(recs(spark, sf_dir))


@query("inventory_findings", f"WITH {b.RECS_SQL} SELECT session_id, count(*) AS total, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'LOW') AS low, count(*) FILTER (status = 'DEAD') AS dead, count(*) FILTER (status IN ('CRITICAL', 'LOW')) AS below_safe, count(*) FILTER (spoilage IN ('HIGH', 'MEDIUM')) AS spoilage FROM rec GROUP BY ALL")
def inventory_findings(spark, sf_dir):
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    return recs(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("total"), c("CRITICAL").alias("critical"), c("LOW").alias("low"), c("DEAD").alias("dead"), c("CRITICAL", "LOW").alias("below_safe"), F.count_if(F.col("spoilage").isin("HIGH", "MEDIUM")).alias("spoilage"))


@query("rec_findings", f"{BASE} SELECT session_id, count(*) AS n, count(*) FILTER (pattern <> 'stable') AS flagged, count(*) FILTER (risk = 'HIGH') AS high_risk FROM ok GROUP BY ALL")
def rec_findings(spark, sf_dir):
    return reports.valid(recs(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("pattern") != "stable").alias("flagged"), F.count_if(F.col("risk") == "HIGH").alias("high_risk"))


@query("results_summary", f"{EFF} SELECT session_id, count(*) AS to_order, count(*) FILTER (order_status = 'overdue') AS overdue, count(*) FILTER (order_status = 'urgent') AS urgent FROM d GROUP BY ALL")
def results_summary(spark, sf_dir):
    rows = reports.with_order_by(reports.valid(recs(spark, sf_dir)), as_of())
    return rows.groupBy("session_id").agg(F.count("*").alias("to_order"), F.count_if(F.col("order_status") == "overdue").alias("overdue"), F.count_if(F.col("order_status") == "urgent").alias("urgent"))


@query("chat_top_k", f"""WITH {b.RECS_SQL} SELECT session_id, status AS bucket, pos, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, status ORDER BY pos) AS k FROM rec)
WHERE k <= CASE status WHEN 'CRITICAL' THEN 30 WHEN 'LOW' THEN 40 WHEN 'DEAD' THEN 20 END""")
def chat_top_k(spark, sf_dir):
    limits = {"CRITICAL": 30, "LOW": 40, "DEAD": 20}
    return reports.first_k(recs(spark, sf_dir), F.when(F.col("status").isin(*limits), F.col("status")), limits).select("session_id", "bucket", "pos", "rank")


@query("run_digest", f"""WITH {b.RECS_SQL}, l AS (SELECT session_id, 1 AS part, pos, 'CRITICAL: ' || item || ' (' || CAST(CAST(stock AS BIGINT) AS VARCHAR) || ')' AS line FROM rec WHERE status = 'CRITICAL' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) <= 30
UNION ALL SELECT session_id, 2, pos, 'PENDING: ' || item || ' x ' || suggested || ' from ' || coalesce(supplier, 'Unknown') FROM rec WHERE NOT error AND NOT approved AND NOT dismissed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) <= 20
UNION ALL SELECT session_id, 3, pos, 'LOW: ' || item FROM rec WHERE status = 'LOW' AND session_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) <= 40),
h AS (SELECT session_id, 0 AS part, CAST(0 AS BIGINT) AS pos, count(*) || ' items: ' || count(*) FILTER (status = 'CRITICAL') || ' critical, ' || count(*) FILTER (status = 'LOW') || ' low, ' || count(*) FILTER (status = 'DEAD') || ' dead' AS line FROM rec GROUP BY session_id)
SELECT session_id, string_agg(line, chr(10) ORDER BY part, pos) AS digest FROM (SELECT * FROM h UNION ALL SELECT * FROM l) GROUP BY session_id""")
def run_digest(spark, sf_dir):
    """A run in text: counts, the first critical and pending lines, and (as an option, here for even sessions) low ones."""
    r = recs(spark, sf_dir)
    number = lambda s: F.count_if(F.col("status") == s).cast("string")
    head = r.groupBy("session_id").agg(F.concat(F.count("*").cast("string"), F.lit(" items: "), number("CRITICAL"), F.lit(" critical, "), number("LOW"), F.lit(" low, "), number("DEAD"), F.lit(" dead")).alias("line"))

    def lines(part, rows, limit, *text):
        first = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
        return rows.withColumn("k", first).where(F.col("k") <= limit).select("session_id", F.lit(part).alias("part"), "pos", F.concat(*text).alias("line"))

    found = lines(1, r.where("status = 'CRITICAL'"), 30, F.lit("CRITICAL: "), "item", F.lit(" ("), F.col("stock").cast("bigint").cast("string"), F.lit(")"))
    found = found.union(lines(2, r.where("NOT error AND NOT approved AND NOT dismissed"), 20, F.lit("PENDING: "), "item", F.lit(" x "), F.col("suggested").cast("string"), F.lit(" from "), F.coalesce("supplier", F.lit("Unknown"))))
    found = found.union(lines(3, r.where("status = 'LOW' AND session_id % 2 = 0"), 40, F.lit("LOW: "), "item")).union(head.select("session_id", F.lit(0), F.lit(0).cast("bigint"), "line"))
    return found.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("x")).select("session_id", F.array_join("x.line", "\n").alias("digest"))


@query("actionable_items", f"WITH {b.RECS_SQL} SELECT session_id, pos, status, spoilage FROM rec WHERE status IN ('LOW', 'CRITICAL') OR (status NOT IN ('HEALTHY', 'DEAD') AND spoilage IN ('HIGH', 'MEDIUM'))")
def actionable_items(spark, sf_dir):
    return recs(spark, sf_dir).where("status <> 'DEAD' AND (status IN ('LOW', 'CRITICAL') OR (status <> 'HEALTHY' AND spoilage IN ('HIGH', 'MEDIUM')))").select("session_id", "pos", "status", "spoilage")


@query("batching", f"WITH {b.RECS_SQL} SELECT session_id, pos, CAST((row_number() OVER (PARTITION BY session_id ORDER BY stock, pos) - 1) // 300 AS BIGINT) AS health_batch, CAST((row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) // 150 AS BIGINT) AS rec_batch FROM rec")
def batching(spark, sf_dir):
    numbered_by = lambda rows, name, *by: plain(in_order(rows, ["session_id"], list(by), {name: Number()}))
    rows = numbered_by(numbered_by(recs(spark, sf_dir).select("session_id", "pos", "stock"), "a", "stock", "pos"), "b", "pos")
    return rows.select("session_id", "pos", F.floor((F.col("a") - 1) / 300).alias("health_batch"), F.floor((F.col("b") - 1) / 150).alias("rec_batch"))


@query("order_covers", f"{BASE} SELECT session_id, pos, CASE WHEN suggested > 0 AND avg_monthly > 0 THEN round_even(CAST(suggested AS DOUBLE) / avg_monthly, 1) END AS covers FROM ok")
def order_covers(spark, sf_dir):
    return reports.valid(recs(spark, sf_dir)).select("session_id", "pos", decisions.order_covers(F.col("suggested").cast("double"), F.col("avg_monthly")).alias("covers"))


@query("safety_buffer", f"WITH {b.RECS_SQL} SELECT session_id, pos, CAST(CASE WHEN delay <= 0.15 THEN 0.5 WHEN delay <= 0.35 THEN 1.5 ELSE 2.5 END AS DOUBLE) AS buffer FROM rec")
def safety_buffer(spark, sf_dir):
    return recs(spark, sf_dir).select("session_id", "pos", decisions.safety_buffer(F.col("delay")).alias("buffer"))


@query("suggested_quantity", f"WITH {b.RECS_SQL} SELECT session_id, pos, CASE WHEN avg_monthly > 0 THEN CAST(round_even(round_even(avg_monthly, 1) * (coalesce(CAST(lead_days AS DOUBLE) / 30, 2.0) + CASE WHEN delay <= 0.15 THEN 0.5 WHEN delay <= 0.35 THEN 1.5 ELSE 2.5 END), 0) AS BIGINT) END AS quantity FROM rec")
def suggested_quantity(spark, sf_dir):
    return recs(spark, sf_dir).select("session_id", "pos", decisions.suggested_quantity(F.col("avg_monthly"), F.col("lead_days"), F.col("delay")).alias("quantity"))


@query("expected_status", f"""WITH {b.RECS_SQL}, x AS (SELECT *, CASE WHEN pos % 11 = 0 THEN NULL ELSE stock END AS st, CASE WHEN pos % 10 = 0 THEN NULL ELSE CAST(pos % 4 AS DOUBLE) * 30 END AS sold, CASE WHEN pos % 13 = 0 THEN NULL ELSE CAST(pos % 120 AS DOUBLE) / 10 END AS mos FROM rec)
SELECT session_id, pos, CASE WHEN st IS NULL AND coalesce(sold, 0) > 0 THEN 'LOW' WHEN st IS NULL THEN 'HEALTHY' WHEN sold IS NULL AND st = 0 THEN 'DEAD' WHEN sold IS NULL THEN 'HEALTHY' WHEN sold > 0 AND st = 0 THEN 'CRITICAL' WHEN mos IS NULL THEN NULL
WHEN mos < coalesce(round_even(CAST(lead_days AS DOUBLE) / 30, 1), 1.0) THEN 'CRITICAL' WHEN mos <= coalesce(round_even(CAST(lead_days AS DOUBLE) / 30, 1), 1.0) + 2 THEN 'LOW' ELSE 'HEALTHY' END AS expected FROM x""")
def expected_status(spark, sf_dir):
    k = F.col("pos")
    x = recs(spark, sf_dir).withColumns({"st": F.when(k % 11 != 0, F.col("stock")), "sold": F.when(k % 10 != 0, (k % 4).cast("double") * 30), "mos": F.when(k % 13 != 0, (k % 120).cast("double") / 10)})
    return x.select("session_id", "pos", decisions.expected_status(F.col("mos"), F.bround(F.col("lead_days") / 30, 1), F.col("st"), F.col("sold")).alias("expected"))


@query("months_of_supply", f"WITH {b.RECS_SQL} SELECT session_id, pos, CASE WHEN avg_monthly > 0 THEN round_even(stock / avg_monthly, 1) END AS months FROM rec")
def months_of_supply(spark, sf_dir):
    return recs(spark, sf_dir).select("session_id", "pos", decisions.months_of_supply(F.col("stock"), F.col("avg_monthly")).alias("months"))


@query("sanitize_quantity", f"""WITH {b.RECS_SQL} SELECT session_id, pos, CASE WHEN suggested > 0 THEN CAST(CASE WHEN pos % 3 = 0 AND pos % 9000 BETWEEN 1 AND 10 * suggested THEN pos % 9000 ELSE suggested END AS VARCHAR)
WHEN pos % 3 = 1 THEN 'ask the buyer' ELSE 'Verify with team' END AS quantity FROM rec""")
def sanitize_quantity(spark, sf_dir):
    k = F.col("pos")
    text = F.when(k % 3 == 0, F.concat(F.lit("about "), (k % 9000).cast("string"), F.lit(" units"))).when(k % 3 == 1, "ask the buyer")
    return recs(spark, sf_dir).select("session_id", "pos", decisions.sanitized_quantity(text, F.col("suggested").cast("double")).alias("quantity"))


@query("confidence_reasons", f"""{BASE} SELECT session_id, pos, list_filter([CASE WHEN confidence = 'INSUFFICIENT_DATA' THEN 'Supplier or sales history not in system.' END, CASE WHEN coalesce(supplier, '') IN ('', 'Unknown') THEN 'Supplier not on file.' END,
CASE WHEN lead_days IS NULL THEN 'Lead time unknown — buffer based on supplier type.' ELSE 'Lead time on file: ' || lead_days || ' days.' END, CASE WHEN days_of_supply IS NULL THEN 'Stock runway unknown — limited sales history.' END,
CASE WHEN risk = 'HIGH' THEN 'Supplier flagged as high-risk (delays or unreliable).' END, CASE WHEN pattern <> 'stable' THEN pattern || ' sales' END], lambda x: x IS NOT NULL) AS reasons FROM ok""")
def confidence_reasons(spark, sf_dir):
    flags = F.when(F.col("pattern") != "stable", F.array(F.concat("pattern", F.lit(" sales"))))
    c = [F.col(x) for x in ("confidence", "supplier", "lead_days", "days_of_supply", "risk")]
    return reports.valid(recs(spark, sf_dir)).select("session_id", "pos", decisions.confidence_reasons(*c, flags).alias("reasons"))


def _pairs(spark, sf_dir):
    """Sessions of one organisation, five apart: the older and the newer of each pair."""
    r = recs(spark, sf_dir).select("session_id", "item", "pos", "status")
    return r.where("session_id < 35").withColumn("pair", F.col("session_id")), r.where("session_id >= 5").withColumn("pair", F.col("session_id") - 5)


@query("run_diff", f"""WITH {b.RECS_SQL}, l AS (SELECT session_id, item, arg_max(status, pos) AS status FROM rec GROUP BY ALL), o AS (SELECT session_id AS pair, item, status AS was FROM l WHERE session_id < 35), n AS (SELECT session_id - 5 AS pair, item, status AS now FROM l WHERE session_id >= 5)
SELECT pair, item, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'resolved' WHEN was = now THEN 'unchanged' WHEN now = 'CRITICAL' THEN 'escalated' WHEN was = 'CRITICAL' THEN 'improved' ELSE 'status_changed' END AS change FROM o FULL JOIN n USING (pair, item)""")
def run_diff(spark, sf_dir):
    return reports.run_diff(*_pairs(spark, sf_dir))


@query("newly_critical", f"WITH {b.RECS_SQL} SELECT DISTINCT session_id, item FROM rec WHERE status = 'CRITICAL' AND session_id >= 5 EXCEPT SELECT session_id + 5, item FROM rec WHERE status = 'CRITICAL'")
def newly_critical(spark, sf_dir):
    r = recs(spark, sf_dir)
    return reports.newly_critical(r.where("session_id >= 5"), r.withColumn("session_id", F.col("session_id") + 5))


@query("verify_report", f"""WITH {b.RECS_SQL}, t AS (SELECT session_id, item, arg_min(CASE pos % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HEALTHY' ELSE 'DEAD' END, pos) AS ts, arg_min(CAST(pos % 190 AS DOUBLE), pos) AS td, arg_min(CAST(pos % 2 AS DOUBLE), pos) AS sold FROM rec GROUP BY ALL),
j AS (SELECT r.*, ts, td, sold, CASE WHEN r.status = 'DEAD' AND sold = 0 THEN 'DEAD' ELSE ts END AS ns FROM rec r JOIN t USING (session_id, item)),
k AS (SELECT *, CASE WHEN ns <> 'DEAD' AND (days_of_supply IS NULL OR abs(days_of_supply - td) > greatest(3.0, td / 10)) THEN td ELSE days_of_supply END AS nd, CASE WHEN ns = 'DEAD' THEN 'NONE' ELSE spoilage END AS np FROM j)
SELECT session_id, item, ns AS status, nd AS days_of_supply, np AS spoilage, CAST(ns IS DISTINCT FROM status AS INTEGER) + CAST(nd IS DISTINCT FROM days_of_supply AS INTEGER) + CAST(np IS DISTINCT FROM spoilage AS INTEGER) AS fixed FROM k""")
def verify_report(spark, sf_dir):
    r = recs(spark, sf_dir)
    k = F.col("pos")
    t = r.select("session_id", "item", "pos", F.when(k % 3 == 0, "CRITICAL").when(k % 3 == 1, "HEALTHY").otherwise("DEAD").alias("status"), (k % 190).cast("double").alias("days_of_supply"), (k % 2).cast("double").alias("sold"))
    t = t.groupBy("session_id", "item").agg(*[F.min_by(c, "pos").alias(c) for c in ("status", "days_of_supply", "sold")])
    return reports.verify_report(r.select("session_id", "item", "status", "days_of_supply", "spoilage"), t)


@query("pattern_flags", f"{BASE} SELECT session_id, pos, pattern AS sales_pattern, CASE WHEN pattern <> 'stable' THEN [pattern || ' sales'] ELSE [] END AS flags, CASE WHEN pattern <> 'stable' AND confidence = 'HIGH' THEN 'MEDIUM' ELSE confidence END AS confidence FROM ok")
def pattern_flags(spark, sf_dir):
    odd = F.col("pattern") != "stable"
    flags = F.when(odd, F.array(F.concat("pattern", F.lit(" sales")))).otherwise(F.array().cast("array<string>"))
    return reports.valid(recs(spark, sf_dir)).select("session_id", "pos", F.col("pattern").alias("sales_pattern"), flags.alias("flags"), F.when(odd & (F.col("confidence") == "HIGH"), "MEDIUM").otherwise(F.col("confidence")).alias("confidence"))


@query("stock_on_hand", f"WITH {b.RECS_SQL} SELECT session_id, item, arg_min(stock, pos) AS stock, arg_max(status, pos) AS status FROM rec GROUP BY ALL")
def stock_on_hand(spark, sf_dir):
    return recs(spark, sf_dir).groupBy("session_id", F.trim("item").alias("item")).agg(F.min_by("stock", "pos").alias("stock"), F.max_by("status", "pos").alias("status"))


@query("session_stats", f"WITH {b.RECS_SQL} SELECT session_id, count(DISTINCT item) AS skus, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'LOW') AS low, count(*) FILTER (NOT error) AS recs, count(*) FILTER (approved AND NOT error) AS approved FROM rec GROUP BY ALL")
def session_stats(spark, sf_dir):
    return recs(spark, sf_dir).groupBy("session_id").agg(F.count_distinct("item").alias("skus"), F.count_if(F.col("status") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "LOW").alias("low"), F.count_if(~F.col("error")).alias("recs"), F.count_if(F.col("approved") & ~F.col("error")).alias("approved"))


@query("starter_questions", f"""{BASE}, c AS (SELECT session_id, count(*) FILTER (status = 'CRITICAL') AS crit, count(*) FILTER (NOT approved AND NOT dismissed) AS pend, count(*) FILTER (status = 'DEAD') AS dead, count(*) FILTER (status = 'LOW') AS low,
list_slice(list_sort(list(DISTINCT coalesce(supplier, '?')) FILTER (risk = 'HIGH')), 1, 3) AS names FROM ok WHERE NOT (session_id % 4 = 1 AND status = 'CRITICAL') GROUP BY ALL)
SELECT session_id, list_slice(list_filter([CASE WHEN crit > 0 THEN 'I have ' || crit || ' critical items. What should I order first?' END, CASE WHEN pend > 0 THEN 'Walk me through the ' || pend || ' pending recommendations.' END,
CASE WHEN len(names) > 0 THEN 'What is the risk with ' || array_to_string(names, ', ') || '?' END, CASE WHEN dead > 0 THEN 'Should I discontinue any of these ' || dead || ' dead items?' END, CASE WHEN low > 0 THEN 'Which of my ' || low || ' low-stock items need action soonest?' END,
'Give me a quick summary of my stock.'], lambda x: x IS NOT NULL), 1, 4) AS questions FROM c""")
def starter_questions(spark, sf_dir):
    """Up to four questions that the data suggests; every fourth session has no critical items."""
    rows = reports.valid(recs(spark, sf_dir)).where("NOT (session_id % 4 = 1 AND status = 'CRITICAL')")
    risky = F.slice(F.array_sort(F.collect_set(F.when(F.col("risk") == "HIGH", F.coalesce("supplier", F.lit("?"))))), 1, 3)
    c = rows.groupBy("session_id").agg(F.count_if(F.col("status") == "CRITICAL").alias("crit"), F.count_if(~F.col("approved") & ~F.col("dismissed")).alias("pend"), F.count_if(F.col("status") == "DEAD").alias("dead"), F.count_if(F.col("status") == "LOW").alias("low"), risky.alias("names"))
    ask = lambda n, before, after: F.when(F.col(n) > 0, F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after)))
    names = F.when(F.size("names") > 0, F.concat(F.lit("What is the risk with "), F.array_join("names", ", "), F.lit("?")))
    questions = F.array_compact(F.array(
        ask("crit", "I have ", " critical items. What should I order first?"), ask("pend", "Walk me through the ", " pending recommendations."), names, ask("dead", "Should I discontinue any of these ", " dead items?"),
        ask("low", "Which of my ", " low-stock items need action soonest?"), F.lit("Give me a quick summary of my stock."),
    ))
    return c.select("session_id", F.slice(questions, 1, 4).alias("questions"))


@query("rec_predicates", f"{BASE} SELECT session_id, pos, NOT approved AND NOT dismissed AS pending, approved, risk = 'HIGH' AS high_risk FROM ok")
def rec_predicates(spark, sf_dir):
    """Valid recommendations with the flags that lists filter by."""
    return reports.valid(recs(spark, sf_dir)).select("session_id", "pos", (~F.col("approved") & ~F.col("dismissed")).alias("pending"), "approved", (F.col("risk") == "HIGH").alias("high_risk"))


@query("quantity_basis", f"""{EFF}, q AS (SELECT *, CASE WHEN avg_monthly = floor(avg_monthly) THEN CAST(CAST(avg_monthly AS BIGINT) AS VARCHAR) ELSE CAST(round_even(avg_monthly, 1) AS VARCHAR) END AS a, round_even(CAST(lead_days AS DOUBLE) / 30, 1) AS lm FROM e)
SELECT session_id, pos, CASE WHEN avg_monthly > 0 THEN 'You sell about ' || a || CASE WHEN pos % 2 = 0 THEN ' CTN' ELSE ' units' END || '/month' || coalesce(', and this supplier takes about ' || CASE WHEN lm = floor(lm) THEN CAST(CAST(lm AS BIGINT) AS VARCHAR) ELSE CAST(lm AS VARCHAR) END || ' months', '')
|| '. Suggested order: ' || eff_quantity || ' — covers ' || CASE WHEN lm IS NULL THEN 'expected demand plus a safety buffer.' ELSE 'the wait plus a safety buffer.' END END AS basis FROM q""")
def quantity_basis(spark, sf_dir):
    rows = reports.with_effective(reports.valid(recs(spark, sf_dir)))
    return rows.select("session_id", "pos", decisions.quantity_basis(F.col("avg_monthly"), F.when(F.col("pos") % 2 == 0, " CTN"), F.col("eff_quantity"), F.col("lead_days")).alias("basis"))


@query("has_stakes", f"WITH {b.RECS_SQL} SELECT session_id, pos, pos % 5 IN (0, 3) AS stakes FROM rec")
def has_stakes(spark, sf_dir):
    """Of five kinds of pairs of consequences two say something."""
    k = F.col("pos") % 5
    bad, good = F.when(k == 0, "You may run out").when(k == 1, "  ").when(k == 2, ""), F.when(k == 3, "Stock lasts").when(k == 4, " ")
    return recs(spark, sf_dir).select("session_id", "pos", decisions.has_stakes(bad, good).alias("stakes"))


RUNS = f"""WITH {b.RECS_SQL}, run AS (SELECT session_id % 5 AS org, session_id, min(created) AS created FROM rec GROUP BY ALL), lr AS (SELECT org, arg_max(session_id, (created, session_id)) AS session_id FROM run GROUP BY ALL)"""


def latest_runs(spark, sf_dir):
    runs = recs(spark, sf_dir).groupBy((F.col("session_id") % 5).alias("org"), "session_id").agg(F.min("created").alias("created"))
    return runs.groupBy("org").agg(F.max_by("session_id", F.struct("created", "session_id")).alias("session_id"))


@query("latest_run", f"{RUNS} SELECT * FROM lr")
def latest_run(spark, sf_dir):
    return latest_runs(spark, sf_dir)


@query("chat_counts", f"""{RUNS} SELECT org, session_id, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'LOW') AS low, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEAD') AS dead,
count(*) FILTER (NOT error AND NOT approved AND NOT dismissed) AS pending, count(*) FILTER (NOT error AND approved) AS approved, count(*) FILTER (NOT error AND risk = 'HIGH') AS high_risk FROM lr JOIN rec USING (session_id) GROUP BY ALL""")
def chat_counts(spark, sf_dir):
    """Counts of each organisation's latest run."""
    rows = recs(spark, sf_dir).join(latest_runs(spark, sf_dir), "session_id")
    ok, status = ~F.col("error"), lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return rows.groupBy("org", "session_id").agg(
        *[status(s) for s in ("CRITICAL", "LOW", "HEALTHY", "DEAD")], F.count_if(ok & ~F.col("approved") & ~F.col("dismissed")).alias("pending"), F.count_if(ok & F.col("approved")).alias("approved"), F.count_if(ok & (F.col("risk") == "HIGH")).alias("high_risk")
    )


@query("dedup_scope", f"""WITH {b.RECS_SQL}, f AS (SELECT session_id, lower(trim(item)) AS name, count(*) AS n FROM rec GROUP BY ALL) SELECT session_id, name, CAST(row_number() OVER (PARTITION BY session_id ORDER BY name) AS INTEGER) AS place FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, name) <= 20)""")
def dedup_scope(spark, sf_dir):
    """The 20 names of a session with most transactions, in the order of names."""
    by = lambda *c: F.row_number().over(Window.partitionBy("session_id").orderBy(*c))
    names = recs(spark, sf_dir).groupBy("session_id", F.lower(F.trim("item")).alias("name")).agg(F.count("*").alias("n"))
    return names.withColumn("top", by(F.desc("n"), "name")).where("top <= 20").select("session_id", "name", by("name").alias("place"))
