"""Action log, outcomes, scores, run history, usage and throttling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import actions
from shelfspark.operators.durable import new_folder
from shelfspark.sources import bindings as b
from shelfspark.sources import sinks

from .register import Register

REGISTER = query = Register()

LOG = """WITH a AS (SELECT user_id % 20 AS session_id, event_id % 500 AS item_no, CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'dismiss' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'order_placed' ELSE 'outcome' END AS action, value, ts, event_id FROM events),
ad AS (SELECT session_id, item_no, action FROM a WHERE action IN ('approve', 'dismiss') QUALIFY row_number() OVER (PARTITION BY session_id, item_no ORDER BY ts DESC, event_id DESC) = 1),
ed AS (SELECT session_id, item_no, value FROM a WHERE action = 'edit' AND value >= 0 QUALIFY row_number() OVER (PARTITION BY session_id, item_no ORDER BY ts DESC, event_id DESC) = 1),
oc AS (SELECT session_id, item_no, CASE WHEN value > 0 THEN 'avoided' ELSE 'happened' END AS outcome FROM a WHERE action = 'outcome' QUALIFY row_number() OVER (PARTITION BY session_id, item_no ORDER BY ts DESC, event_id DESC) = 1),
st AS (SELECT k.session_id, k.item_no, coalesce(ad.action = 'approve', false) AS approved, coalesce(ad.action = 'dismiss', false) AS dismissed, CASE WHEN ed.value <> 0 THEN ed.value END AS edited_quantity, k.placed AS order_placed, oc.outcome
       FROM (SELECT session_id, item_no, bool_or(action = 'order_placed') AS placed FROM a GROUP BY ALL) k LEFT JOIN ad USING (session_id, item_no) LEFT JOIN ed USING (session_id, item_no) LEFT JOIN oc USING (session_id, item_no))"""


def state(spark, sf_dir):
    return actions.rec_state(b.rec_actions(spark, sf_dir), ["session_id", "item_no"])


@query("rec_state", f"{LOG} SELECT * FROM st")
def rec_state(spark, sf_dir):
    return state(spark, sf_dir)


@query("action_approve_dismiss", f"{LOG} SELECT session_id, item_no, action = 'approve' AS approved, action = 'dismiss' AS dismissed FROM ad")
def action_approve_dismiss(spark, sf_dir):
    log = b.rec_actions(spark, sf_dir).where("action IN ('approve', 'dismiss')")
    return actions.rec_state(log, ["session_id", "item_no"]).select("session_id", "item_no", "approved", "dismissed")


@query("action_edit", f"{LOG} SELECT session_id, item_no, value AS edited_quantity FROM ed WHERE value <> 0")
def action_edit(spark, sf_dir):
    return state(spark, sf_dir).where("edited_quantity IS NOT NULL").select("session_id", "item_no", "edited_quantity")


@query("action_undo", f"{LOG}, b1 AS (SELECT session_id, item_no FROM st WHERE session_id % 2 = 0 AND NOT dismissed AND NOT approved) SELECT st.session_id, st.item_no, CASE WHEN b1.item_no IS NOT NULL THEN st.item_no % 3 <> 0 ELSE approved END AS approved FROM st LEFT JOIN b1 USING (session_id, item_no)")
def action_undo(spark, sf_dir):
    """Even sessions approve all undecided items, and then take back every third item of these."""
    log = b.rec_actions(spark, sf_dir)
    return actions.bulk(log, state(spark, sf_dir), F.col("session_id") % 2 == 0, F.col("item_no") % 3 == 0).select("session_id", "item_no", "approved")


@query("action_note", f"{LOG}, n AS (SELECT user_id % 20 AS session_id, event_id % 500 AS item_no, repeat(event_type, 200) AS text, 'S' || (event_id % 4) AS supplier, ts, event_id FROM events WHERE event_type = 'view') SELECT session_id, item_no, left(arg_max(text, struct_pack(ts := ts, event_id := event_id)), 500) AS note, nullif(arg_max(supplier, struct_pack(ts := ts, event_id := event_id)), 'S0') AS edited_supplier FROM n GROUP BY ALL")
def action_note(spark, sf_dir):
    """Notes of at most 500 characters, and edited suppliers (S0 is the suggested one, so it takes an edit back)."""
    e = b.table(spark, sf_dir, "events").where("event_type = 'view'")
    rows = e.select((F.col("user_id") % 20).alias("session_id"), (F.col("event_id") % 500).alias("item_no"), F.repeat("event_type", F.lit(200)).alias("note"), F.concat(F.lit("S"), (F.col("event_id") % 4).cast("string")).alias("supplier"), F.lit("S0").alias("suggested"), "ts", "event_id")
    return actions.texts(rows, ["session_id", "item_no"])


@query("action_outcome", f"{LOG} SELECT session_id, item_no, order_placed, outcome FROM st WHERE order_placed OR outcome IS NOT NULL")
def action_outcome(spark, sf_dir):
    return state(spark, sf_dir).where("order_placed OR outcome IS NOT NULL").select("session_id", "item_no", "order_placed", "outcome")


@query("action_approve_all", f"{LOG}, bulk AS (SELECT session_id, max(ts) AS at FROM a WHERE session_id % 2 = 0 GROUP BY ALL) SELECT st.session_id, st.item_no, CASE WHEN bulk.at IS NOT NULL AND NOT dismissed THEN true ELSE approved END AS approved FROM st LEFT JOIN bulk USING (session_id)")
def action_approve_all(spark, sf_dir):
    """A bulk approval at the end of every even session, expanded to its undecided items."""
    log = b.rec_actions(spark, sf_dir)
    now = state(spark, sf_dir)
    bulk = log.where("session_id % 2 = 0").groupBy("session_id").agg(F.max("ts").alias("ts"))
    targets = now.where("NOT dismissed AND NOT approved").select("session_id", "item_no").join(bulk, "session_id")
    wide = targets.select("session_id", "item_no", F.lit("approve").alias("action"), F.lit(None).cast("double").alias("value"), "ts", F.lit(2**62).alias("event_id"))
    return actions.rec_state(log.unionByName(wide), ["session_id", "item_no"]).select("session_id", "item_no", "approved")


STATS = "count(*) AS recs, count(*) FILTER (approved) AS approved, count(*) FILTER (order_placed) AS placed, count(*) FILTER (outcome = 'avoided') AS avoided, count(*) FILTER (outcome = 'happened') AS happened, count(*) FILTER (order_placed AND outcome IS NULL) AS pending"


@query("outcome_stats", f"{LOG}, n AS (SELECT session_id % 5 AS org, {STATS} FROM st GROUP BY ALL) SELECT *, CASE WHEN approved > 0 THEN round_even(100.0::DOUBLE * placed / approved, 1) ELSE 0.0 END AS follow_through, CASE WHEN avoided + happened > 0 THEN round_even(100.0::DOUBLE * avoided / (avoided + happened), 1) ELSE 0.0 END AS success FROM n")
def outcome_stats(spark, sf_dir):
    return actions.outcome_stats(state(spark, sf_dir).withColumn("org", F.col("session_id") % 5), "org")


@query("supplier_scores", f"""{LOG}, n AS (SELECT item_no % 100 + 1 AS k, {STATS} FROM st GROUP BY ALL) SELECT s_name AS supplier, round_even(greatest(0.0, least(100.0, 50.0 + CASE WHEN approved > 0 THEN 20.0::DOUBLE * placed / approved ELSE 0 END
+ CASE WHEN avoided + happened > 0 THEN 30.0::DOUBLE * avoided / (avoided + happened) ELSE 0 END - CASE WHEN (s_suppkey % 50) / 100.0 > 0.3 THEN 10 ELSE 0 END)), 1) AS score, approved, placed FROM n JOIN supplier ON s_suppkey = k""")
def supplier_scores(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("supplier"))
    rows = state(spark, sf_dir).withColumn("k", F.col("item_no") % 100 + 1).join(s, "k")
    return actions.supplier_scores(rows, b.supplier_profiles(spark, sf_dir).select("supplier", F.col("delay_probability").alias("delay")))


@query("supplier_accuracy", f"""WITH {b.RECS_SQL} SELECT session_id % 5 AS org, supplier, count(*) AS total, count(*) FILTER (approved) AS approved, count(*) FILTER (dismissed) AS dismissed FROM rec WHERE supplier IS NOT NULL AND created >= (SELECT max(created) FROM rec) - 90 GROUP BY ALL""")
def supplier_accuracy(spark, sf_dir):
    """Outcomes of the last 90 days, of each organisation's sessions, by supplier."""
    r = b.recommendations(spark, sf_dir)
    sessions = r.select("session_id", (F.col("session_id") % 5).alias("org")).distinct()
    as_of = r.agg(F.max("created").alias("as_of"))
    outcomes = r.where("supplier IS NOT NULL").select("session_id", "supplier", "approved", "dismissed", "created")
    return actions.supplier_accuracy(outcomes, sessions, as_of.first()["as_of"])


@query("outcome_stub_sink", f"WITH {b.RECS_SQL} SELECT session_id, item, supplier, suggested AS action_recommended, 0.0::DOUBLE AS predicted_loss, 0.0::DOUBLE AS predicted_cost, confidence FROM rec WHERE NOT error")
def outcome_stub_sink(spark, sf_dir):
    """The outcome table after a row for each recommendation was written to it, by session, and the odd sessions were run again; predicted
    money is 0 throughout."""
    rows = b.recommendations(spark, sf_dir).where("NOT error").select("session_id", "item", "supplier", F.col("suggested").alias("action_recommended"), F.lit(0.0).alias("predicted_loss"), F.lit(0.0).alias("predicted_cost"), "confidence")
    path = new_folder(spark, "outcomes")
    sinks.write_sessions(rows, path)
    sinks.write_sessions(rows.where("session_id % 2 = 1"), path)
    return sinks.read_sessions(spark, path, rows.schema)


@query("clone_session", f"WITH {b.RECS_SQL} SELECT session_id + 1000 AS session_id, pos, item, status FROM rec WHERE session_id % 10 = 3 UNION ALL SELECT session_id + 1000, event_id, event_type, CAST(user_id AS VARCHAR) FROM (SELECT CAST(user_id % 40 AS BIGINT) AS session_id, * FROM events) WHERE session_id % 10 = 3")
def clone_session(spark, sf_dir):
    """Sessions copied under new numbers, in every table they have (here recommendations and actions): the tables are written, the copies are
    added to them, and what they then hold of the copies is read back."""
    tables = {"recs": b.recommendations(spark, sf_dir).select("session_id", "pos", "item", "status"), "actions": b.table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("long").alias("session_id"), "event_id", "event_type", F.col("user_id").cast("string").alias("who"))}
    pairs = tables["recs"].select("session_id").distinct().where("session_id % 10 = 3").select("session_id", (F.col("session_id") + 1000).alias("new_id"))
    copies, read = actions.clone(tables, pairs), []
    for name, rows in tables.items():
        path = new_folder(spark, name)
        sinks.write_sessions(rows, path)
        sinks.write_sessions(copies[name], path)
        read.append(sinks.read_sessions(spark, path, rows.schema).join(pairs.select(F.col("new_id").alias("session_id")), "session_id", "left_semi"))
    return read[0].union(read[1])


RUNS = f"""WITH {b.RECS_SQL}, run AS (SELECT session_id % 5 AS org, session_id, min(created) AS created, count(*) AS items, count(*) FILTER (error) AS errors,
CASE session_id % 6 WHEN 0 THEN 'analyzing' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'complete' END AS state FROM rec GROUP BY ALL)"""


def runs(spark, sf_dir):
    k = F.col("session_id") % 6
    r = b.recommendations(spark, sf_dir).groupBy("session_id").agg(F.min("created").alias("created"), F.count("*").alias("items"), F.count_if("error").alias("errors"))
    return r.select((F.col("session_id") % 5).alias("org"), "session_id", "created", "items", "errors", F.when(k == 0, "analyzing").when(k == 1, "failed").when(k == 2, "pending").otherwise("complete").alias("state"))


CATEGORY = "CASE WHEN state = 'complete' THEN CASE WHEN items = 0 THEN 'blank' WHEN session_id % 4 = 3 THEN 'incomplete' WHEN errors = items THEN 'recs_failed' ELSE 'healthy' END WHEN state = 'failed' THEN 'failed' WHEN state = 'analyzing' THEN 'running' ELSE 'pending' END"


def categorised(spark, sf_dir):
    done = F.when(F.col("items") == 0, "blank").when(F.col("session_id") % 4 == 3, "incomplete").when(F.col("errors") == F.col("items"), "recs_failed").otherwise("healthy")
    return runs(spark, sf_dir).withColumn("category", F.when(F.col("state") == "complete", done).when(F.col("state") == "failed", "failed").when(F.col("state") == "analyzing", "running").otherwise("pending"))


@query("run_category", f"{RUNS} SELECT org, session_id, {CATEGORY} AS category FROM run")
def run_category(spark, sf_dir):
    return categorised(spark, sf_dir).select("org", "session_id", "category")


@query("org_run_summary", f"{RUNS}, c AS (SELECT org, {CATEGORY} AS category FROM run) SELECT org, count(*) FILTER (category = 'healthy') AS healthy, count(*) FILTER (category = 'failed') AS failed, count(*) FILTER (category = 'incomplete') AS incomplete, count(*) FILTER (category = 'running') AS running, count(*) FILTER (category = 'pending') AS pending, count(*) AS total, count(*) FILTER (category IN ('blank', 'failed', 'recs_failed', 'incomplete')) AS alertable FROM c GROUP BY ALL")
def org_run_summary(spark, sf_dir):
    kinds = ["healthy", "failed", "incomplete", "running", "pending"]
    n = lambda *k: F.count_if(F.col("category").isin(*k))
    return categorised(spark, sf_dir).groupBy("org").agg(*[n(k).alias(k) for k in kinds], F.count("*").alias("total"), n("blank", "failed", "recs_failed", "incomplete").alias("alertable"))


@query("previous_run", f"{RUNS} SELECT org, session_id, lag(session_id) OVER (PARTITION BY org ORDER BY created, session_id) AS before FROM run WHERE state = 'complete'")
def previous_run(spark, sf_dir):
    w = Window.partitionBy("org").orderBy("created", "session_id")
    return runs(spark, sf_dir).where("state = 'complete'").select("org", "session_id", F.lag("session_id").over(w).alias("before"))


@query("recent_runs", f"{RUNS} SELECT org, session_id, CAST(row_number() OVER (PARTITION BY org ORDER BY created DESC, session_id DESC) AS INTEGER) AS place FROM run QUALIFY row_number() OVER (PARTITION BY org ORDER BY created DESC, session_id DESC) <= 10")
def recent_runs(spark, sf_dir):
    w = Window.partitionBy("org").orderBy(F.desc("created"), F.desc("session_id"))
    return runs(spark, sf_dir).select("org", "session_id", F.row_number().over(w).alias("place")).where("place <= 10")


@query("history", f"{RUNS} SELECT org, session_id, items, errors FROM run WHERE state = 'complete' QUALIFY row_number() OVER (PARTITION BY org ORDER BY created DESC, session_id DESC) <= 50")
def history(spark, sf_dir):
    w = Window.partitionBy("org").orderBy(F.desc("created"), F.desc("session_id"))
    return runs(spark, sf_dir).where("state = 'complete'").withColumn("k", F.row_number().over(w)).where("k <= 50").select("org", "session_id", "items", "errors")


@query("stale_runs", "SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'O' AND (o_orderkey % 300 > 120 OR o_orderkey % 40 = 7) THEN 'failed' WHEN o_orderstatus = 'O' THEN 'analyzing' ELSE 'complete' END AS state FROM orders")
def stale_runs(spark, sf_dir):
    """Runs that have been analysing for over 120 seconds, or that a restart (a boot sweep, here every fortieth) finds unfinished, failed."""
    as_of = F.lit(b.AS_OF).cast("timestamp")
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(k.alias("run"), F.when(F.col("o_orderstatus") == "O", "analyzing").otherwise("complete").alias("state"), F.timestamp_seconds(F.unix_timestamp(as_of) - k % 300).alias("started"), (k % 40 == 7).alias("swept"))
    return actions.stale(o, as_of).select("run", "state")


@query("newest_result_per_session", f"{RUNS}, res AS (SELECT o_custkey % 40 AS session_id, max(o_orderkey) AS result FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 40 <> 5 GROUP BY ALL) SELECT session_id, result FROM run LEFT JOIN res USING (session_id) WHERE created >= DATE '1995-01-15'")
def newest_result_per_session(spark, sf_dir):
    """The newest analysis row of each session that is recent enough; a session may have none."""
    o = b.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0 AND o_custkey % 40 <> 5")
    results = o.groupBy((F.col("o_custkey") % 40).cast("long").alias("session_id")).agg(F.max("o_orderkey").alias("result"))
    return runs(spark, sf_dir).where("created >= DATE '1995-01-15'").select("session_id").join(results, "session_id", "left")


@query("org_last_login", "WITH l AS (SELECT user_id % 9 AS org, max(ts) AS last_login FROM events WHERE user_id % 9 <> 7 GROUP BY ALL), r AS (SELECT o_custkey % 12 AS org, count(*) AS runs FROM orders WHERE o_custkey % 12 <> 2 GROUP BY ALL) SELECT coalesce(l.org, r.org) AS org, last_login, coalesce(runs, 0) AS runs FROM l FULL JOIN r ON l.org = r.org")
def org_last_login(spark, sf_dir):
    """Organisations that ran something, with their last login, and those that only logged in."""
    logins = b.table(spark, sf_dir, "events").where("user_id % 9 <> 7").groupBy((F.col("user_id") % 9).alias("org")).agg(F.max("ts").alias("last_login"))
    ran = b.table(spark, sf_dir, "orders").where("o_custkey % 12 <> 2").groupBy((F.col("o_custkey") % 12).alias("org")).agg(F.count("*").alias("runs"))
    return logins.join(ran, "org", "full_outer").select("org", "last_login", F.coalesce("runs", F.lit(0)).alias("runs"))


@query("orphan_profiles", f"WITH {b.RECS_SQL} SELECT s_name AS supplier FROM supplier WHERE 'Supplier ' || s_suppkey NOT IN (SELECT supplier FROM rec WHERE supplier IS NOT NULL)")
def orphan_profiles(spark, sf_dir):
    seen = b.recommendations(spark, sf_dir).select("supplier").distinct()
    s = b.table(spark, sf_dir, "supplier").select("s_name", F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("supplier"))
    return s.join(seen, "supplier", "left_anti").select(F.col("s_name").alias("supplier"))


@query("company_config", """SELECT n_nationkey AS org, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 10 ELSE 56 END AS lead_days, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN n_nationkey + 0.5::DOUBLE ELSE 50.0::DOUBLE END AS stockout_cost, 2.0::DOUBLE AS holding_cost, 0.95::DOUBLE AS service_level, CAST(7 AS INTEGER) AS lead_variance,
CASE WHEN n_nationkey % 3 = 0 THEN 'food' ELSE 'general' END AS industry, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '' END AS description FROM nation""")
def company_config(spark, sf_dir):
    """The settings of an organisation, field by field, else defaults."""
    orgs = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org"), "n_name")
    k = F.col("org")
    config = orgs.where("org % 3 = 0").select("org", (k + 10).alias("lead_days"), F.when(k % 2 == 0, k + 0.5).alias("stockout_cost"), F.lit(None).cast("double").alias("holding_cost"), F.lit(None).cast("double").alias("service_level"), F.lit(None).cast("int").alias("lead_variance"), F.lit("food").alias("industry"), F.col("n_name").alias("description"))
    return actions.with_defaults(orgs.select("org"), config, "org", actions.COMPANY_DEFAULTS)


FIELDS = "CASE event_type WHEN 'view' THEN 'lead_days' WHEN 'click' THEN 'delay' WHEN 'error' THEN 'notes' ELSE 'hacked' END"


@query("profile_upsert", f"SELECT user_id AS profile, {FIELDS} AS field, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL")
def profile_upsert(spark, sf_dir):
    """The latest value of each field that may be written; others are ignored."""
    kinds = F.when(F.col("event_type") == "view", "lead_days").when(F.col("event_type") == "click", "delay").when(F.col("event_type") == "error", "notes").otherwise("hacked")
    e = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("profile"), kinds.alias("field"), "value", "ts", "event_id")
    return actions.upsert(e, ["profile"], ("lead_days", "delay", "notes"))


@query("config_upsert", f"WITH x AS (SELECT user_id % 25 AS org, {FIELDS} AS field, value, ts, event_id FROM events) SELECT org, arg_max(value, struct_pack(ts := ts, event_id := event_id)) FILTER (field = 'lead_days') AS lead_days, arg_max(value, struct_pack(ts := ts, event_id := event_id)) FILTER (field = 'delay') AS delay FROM x WHERE field IN ('lead_days', 'delay') GROUP BY ALL")
def config_upsert(spark, sf_dir):
    """Settings after all writes, one row an organisation."""
    kinds = F.when(F.col("event_type") == "view", "lead_days").when(F.col("event_type") == "click", "delay").otherwise("hacked")
    e = b.table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("org"), kinds.alias("field"), "value", "ts", "event_id")
    return actions.upsert(e, ["org"], ("lead_days", "delay")).groupBy("org").pivot("field", ["lead_days", "delay"]).agg(F.first("value"))


@query("throttle_exceeded", "SELECT event_id, user_id AS key, count(*) OVER w AS hits, count(*) OVER w > 3 AS exceeded FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '863999999999 microseconds' PRECEDING AND CURRENT ROW)")
def throttle_exceeded(spark, sf_dir):
    return actions.throttled(b.table(spark, sf_dir, "events").withColumn("key", F.col("user_id")), 3, 864000)


@query("lockout_audit", """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM events),
w AS (SELECT event_id, user_id AS key, ts, count(*) OVER x AS failures, min(ts) OVER x AS oldest FROM e WHERE event_type <> 'purchase' WINDOW x AS (PARTITION BY user_id, ep ORDER BY ts RANGE BETWEEN INTERVAL '863999999999 microseconds' PRECEDING AND CURRENT ROW))
SELECT event_id, key, failures, failures >= 5 AS locked, CASE WHEN failures >= 5 THEN 864000 - (CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(oldest)) AS BIGINT)) END AS unlock_in FROM w""")
def lockout_audit(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").withColumns({"key": F.col("user_id"), "success": F.col("event_type") == "purchase"})
    return actions.lockouts(e, 5, 864000)


@query("conversation_list", "WITH c AS (SELECT conv_id, conv_id % 7 AS org, conv_id % 5 = 0 AS pinned, count(*) AS turns, arg_min(left(text, 60), turn) AS title FROM conversations GROUP BY conv_id) SELECT org, conv_id, pinned, turns, title FROM c QUALIFY row_number() OVER (PARTITION BY org ORDER BY pinned DESC, conv_id DESC) <= 50")
def conversation_list(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by(F.substring("text", 1, 60), "turn").alias("title"))
    c = c.withColumns({"org": F.col("conv_id") % 7, "pinned": F.col("conv_id") % 5 == 0})
    w = Window.partitionBy("org").orderBy(F.desc("pinned"), F.desc("conv_id"))
    return c.withColumn("k", F.row_number().over(w)).where("k <= 50").select("org", "conv_id", "pinned", "turns", "title")


@query("conversation_search", "WITH c AS (SELECT conv_id, conv_id % 3 AS owner, conv_id % 5 = 0 AS pinned, arg_min(left(text, 60), turn) AS title FROM conversations GROUP BY conv_id) SELECT owner, conv_id, pinned, title FROM c WHERE contains(lower(title), 'an') QUALIFY row_number() OVER (PARTITION BY owner ORDER BY pinned DESC, conv_id DESC) <= 50")
def conversation_search(spark, sf_dir):
    """A user's own conversations whose title holds the searched text."""
    c = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 60), "turn").alias("title"))
    c = c.withColumns({"owner": F.col("conv_id") % 3, "pinned": F.col("conv_id") % 5 == 0}).where(F.contains(F.lower("title"), F.lit("an")))
    w = Window.partitionBy("owner").orderBy(F.desc("pinned"), F.desc("conv_id"))
    return c.withColumn("k", F.row_number().over(w)).where("k <= 50").select("owner", "conv_id", "pinned", "title")
