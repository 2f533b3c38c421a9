"""Supplier directory queries: each supplier under several spellings, in the organisation of its block of five."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import directory as d
from shelfspark.operators import suppliers
from shelfspark.sources import bindings as b

from .register import Register

REGISTER = query = Register()

BASE = """WITH k AS (SELECT s_suppkey AS k, s_name AS n, replace(s_name, '#', ' # ') AS wide, 'ORG_' || (s_suppkey // 5 % 5) AS org_name FROM supplier),
u AS (SELECT *, CASE WHEN k % 4 = 0 THEN wide WHEN k % 3 = 0 THEN upper(n) ELSE n END AS longest, CASE WHEN k % 4 = 0 THEN 'listing' WHEN k % 3 = 0 THEN 'po' ELSE 'sales' END AS best FROM k),
dir AS (SELECT org_name, k, CASE WHEN k % 5 = 0 AND k % 4 <> 0 THEN n ELSE longest END AS supplier, best AS source, CASE WHEN k % 5 = 1 THEN (SELECT CASE WHEN p.k % 4 = 0 THEN p.wide ELSE p.n END FROM k p WHERE p.k = u.k - 1) END AS merged_into FROM u)"""


def _suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(k.cast("long").alias("k"), F.col("s_name").alias("n"), F.replace(F.col("s_name"), F.lit("#"), F.lit(" # ")).alias("wide"), F.concat(F.lit("ORG_"), (F.floor(k / 5) % 5).cast("string")).alias("org_name"))


def sources(spark, sf_dir):
    """org_name, supplier, source: every name in sales, a third of them in capitals in orders, a quarter more widely spelled in a listing."""
    s = _suppliers(spark, sf_dir)
    row = lambda where, name, source: s.where(where).select("org_name", name.alias("supplier"), F.lit(source).alias("source"))
    return row("true", F.col("n"), "sales").union(row("k % 3 = 0", F.upper("n"), "po")).union(row("k % 4 = 0", F.col("wide"), "listing")).union(row("k % 4 = 0", F.col("wide"), "sales"))


def existing(spark, sf_dir):
    """A fifth of the names is on record, and another fifth in small letters, merged into the name before it."""
    s = _suppliers(spark, sf_dir)
    before = s.select((F.col("k") + 1).alias("k"), F.col("n").alias("merged_into"))
    kept = s.where("k % 5 = 0").select("org_name", F.col("n").alias("supplier"), F.lit("sales").alias("source"), F.lit(None).cast("string").alias("merged_into"))
    return kept.union(s.where("k % 5 = 1").join(before, "k", "left").select("org_name", F.lower("n"), F.lit("listing"), "merged_into"))


def rebuilt(spark, sf_dir):
    return d.rebuild(d.source_union(sources(spark, sf_dir)), existing(spark, sf_dir))


@query("supplier_source_union", f"{BASE}, x AS (SELECT org_name, n AS supplier, 0 AS r FROM k UNION ALL SELECT org_name, upper(n), 1 FROM k WHERE k % 3 = 0 UNION ALL SELECT org_name, wide, 2 FROM k WHERE k % 4 = 0) SELECT org_name, supplier, ['sales', 'po', 'listing'][max(r) + 1] AS source FROM x GROUP BY ALL".replace("['sales', 'po', 'listing'][max(r) + 1] AS source FROM x GROUP BY ALL", "CASE max(r) WHEN 2 THEN 'listing' WHEN 1 THEN 'po' ELSE 'sales' END AS source FROM x GROUP BY org_name, supplier"))
def supplier_source_union(spark, sf_dir):
    return d.source_union(sources(spark, sf_dir))


@query("supplier_directory", f"{BASE} SELECT org_name, supplier, source, merged_into FROM dir")
def supplier_directory(spark, sf_dir):
    return rebuilt(spark, sf_dir)


ACTED = """, act AS (SELECT org_name, k, CASE WHEN k % 5 = 3 AND k % 2 = 0 THEN 'unmerged' WHEN k % 5 = 2 OR k % 5 = 3 THEN 'merged' END AS a FROM k),
now AS (SELECT dir.org_name, dir.supplier, dir.source, CASE WHEN act.a = 'merged' THEN (SELECT p.supplier FROM dir p WHERE p.k = dir.k - dir.k % 5) WHEN act.a = 'unmerged' THEN NULL ELSE dir.merged_into END AS merged_into FROM dir JOIN act USING (org_name, k))"""


def acted(spark, sf_dir):
    """The directory after merges of two names of each block of five into its first, half of one of them undone."""
    s = _suppliers(spark, sf_dir)
    names = rebuilt(spark, sf_dir)
    keyed = s.select("org_name", "k", suppliers.match_key(F.col("n")).alias("key")).join(names.withColumn("key", suppliers.match_key(F.col("supplier"))), ["org_name", "key"]).select("org_name", "k", "supplier")
    first = keyed.where("k % 5 = 0").select("k", F.col("supplier").alias("target"))
    merges = keyed.where("k % 5 IN (2, 3)").withColumn("base", F.col("k") - F.col("k") % 5).join(first.withColumnRenamed("k", "base"), "base")
    log = merges.select("org_name", "supplier", F.lit("merge").alias("action"), "target", F.lit(1).alias("at")).union(
        merges.where("k % 5 = 3 AND k % 2 = 0").select("org_name", "supplier", F.lit("unmerge"), F.lit(None).cast("string"), F.lit(2))
    )
    return d.apply_actions(names, log)


@query("supplier_actions", f"{BASE}{ACTED} SELECT * FROM now")
def supplier_actions(spark, sf_dir):
    return acted(spark, sf_dir)


def profiles(spark, sf_dir):
    """Profiles of two thirds of the names on record, and of one name for each block that no upload mentions."""
    s = _suppliers(spark, sf_dir)
    base = s.where("k % 3 <> 1").select("org_name", F.col("n").alias("supplier"), "k").union(s.where("k % 5 = 4").select("org_name", F.concat(F.lit("By hand "), F.col("k").cast("string")), "k"))
    return base.select("org_name", "supplier", (F.col("k") % 50 / 100).alias("delay_probability"), (F.col("k") % 90).cast("int").alias("avg_lead_time_days"), F.lit(0.8).alias("data_quality_score"), (F.col("k") % 9).alias("total_recs"), (F.col("k") % 7 == 0).alias("archived"))


PROFILES = ", prof AS (SELECT org_name, n AS supplier, k FROM k WHERE k % 3 <> 1 UNION ALL SELECT org_name, 'By hand ' || k, k FROM k WHERE k % 5 = 4), pr AS (SELECT *, CAST(k % 50 AS DOUBLE) / 100 AS delay, CAST(k % 90 AS INTEGER) AS lead, CAST(k % 9 AS BIGINT) AS recs, k % 7 = 0 AS archived FROM prof)"


@query("profile_resolve", f"""{BASE}{ACTED}{PROFILES} SELECT now.org_name, now.supplier, coalesce(merged_into, now.supplier) AS profile, coalesce(pr.delay, 0.2) AS delay, pr.lead AS lead_days, CASE WHEN pr.k IS NULL THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS quality, coalesce(pr.delay, 0.2) > 0.35 AS unreliable
FROM now LEFT JOIN pr ON pr.org_name = now.org_name AND pr.supplier = coalesce(merged_into, now.supplier)""")
def profile_resolve(spark, sf_dir):
    now = acted(spark, sf_dir)
    return d.profile_resolve(now.select("org_name", "supplier"), now, profiles(spark, sf_dir))


@query("directory_profiles", f"""{BASE}{ACTED}{PROFILES}, mg AS (SELECT org_name, merged_into AS supplier, list_sort(list(supplier)) AS names FROM now WHERE merged_into IS NOT NULL GROUP BY ALL),
rows AS (SELECT now.org_name, now.supplier, now.source, recs, delay, coalesce(archived, false) AS archived FROM now LEFT JOIN pr USING (org_name, supplier) WHERE merged_into IS NULL
UNION ALL SELECT org_name, supplier, NULL, recs, delay, archived FROM pr WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.org_name = pr.org_name AND now.supplier = pr.supplier AND merged_into IS NULL))
SELECT rows.org_name, rows.supplier, source, coalesce(mg.names, []) AS merged_names, coalesce(recs, 0) AS total_recs, coalesce(delay > 0.35, false) AS unreliable, archived FROM rows LEFT JOIN mg USING (org_name, supplier) WHERE NOT archived""")
def directory_profiles(spark, sf_dir):
    return d.directory_rows(acted(spark, sf_dir), profiles(spark, sf_dir))


@query("score_list", f"{BASE}{PROFILES} SELECT org_name, supplier, recs AS total_recs, CAST(row_number() OVER (PARTITION BY org_name ORDER BY recs DESC, supplier) AS INTEGER) AS place FROM pr WHERE NOT archived")
def score_list(spark, sf_dir):
    """Suppliers by score, archived ones left out."""
    w = Window.partitionBy("org_name").orderBy(F.desc("total_recs"), "supplier")
    return profiles(spark, sf_dir).where("NOT archived").select("org_name", "supplier", "total_recs", F.row_number().over(w).alias("place"))


@query("supplier_row_unreliable", f"{BASE}{PROFILES} SELECT org_name, supplier, delay > 0.35 AS unreliable, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS flagged_delay FROM pr")
def supplier_row_unreliable(spark, sf_dir):
    """Delays over 0.35; a tick in the box (here: even lead times) writes 0.5, no tick 0.2."""
    p = profiles(spark, sf_dir).withColumn("tick", F.regexp_extract("supplier", r"(\d+)$", 1).cast("long") % 2 == 0)
    return p.select("org_name", "supplier", (F.col("delay_probability") > d.UNRELIABLE).alias("unreliable"), F.when(F.col("tick"), 0.5).otherwise(0.2).alias("flagged_delay"))


def spelled(spark, sf_dir):
    """Each supplier under three spellings, and for a quarter a fourth with two letters changed places."""
    s = _suppliers(spark, sf_dir).withColumn("code", F.translate(F.substring(F.sha2(F.col("n"), 256), 1, 14), "0123456789", "ghijklmnop"))
    base = s.select("org_name", "k", F.concat(F.lit("Acme "), "code").alias("x"))
    typo = base.where("k % 4 = 0").select("org_name", F.regexp_replace("x", r"(.)(.)$", "$2$1").alias("supplier"))
    return base.select("org_name", F.explode(F.array("x", F.concat("x", F.lit(" Pte Ltd")), F.concat("x", F.lit(" Trading")))).alias("supplier")).union(typo).distinct()


SPELLED = """WITH k AS (SELECT s_suppkey AS k, 'ORG_' || (s_suppkey // 5 % 5) AS org_name, 'Acme ' || translate(left(sha256(s_name), 14), '0123456789', 'ghijklmnop') AS x FROM supplier),
t AS (SELECT *, CASE WHEN k % 4 = 0 THEN regexp_replace(x, '(.)(.)$', '\\2\\1') END AS typo FROM k),
a AS (SELECT org_name, least(x, coalesce(typo, x)) AS first, unnest(list_distinct([x, x || ' Pte Ltd', x || ' Trading', coalesce(typo, x)])) AS supplier, x FROM t),
gr AS (SELECT org_name, lower(replace(first, ' ', '')) AS group_key, supplier, CASE WHEN starts_with(supplier, x) THEN 'same name after removing LTD, PTE, TRADING' ELSE 'spelled almost the same' END AS reason FROM a)"""


@query("duplicate_groups", f"{SPELLED} SELECT * FROM gr")
def duplicate_groups(spark, sf_dir):
    return d.duplicate_groups(spelled(spark, sf_dir))


@query("merge_suggestions", f"{SPELLED} SELECT * FROM gr WHERE group_key NOT LIKE '%a_'")
def merge_suggestions(spark, sf_dir):
    """Without dismissed groups (here those whose key ends in a and one more letter)."""
    names = spelled(spark, sf_dir).withColumn("merged_into", F.lit(None).cast("string"))
    ignored = names.select("org_name", suppliers.match_key(F.col("supplier")).alias("group_key")).where("group_key LIKE '%a_'")
    return d.suggestions(names, ignored)


@query("ignored_except", f"{SPELLED}, gk AS (SELECT DISTINCT org_name, group_key FROM gr) SELECT org_name, group_key FROM gk EXCEPT SELECT org_name, group_key FROM gk WHERE group_key LIKE '%b%'")
def ignored_except(spark, sf_dir):
    groups = d.duplicate_groups(spelled(spark, sf_dir)).select("org_name", "group_key").distinct()
    return groups.join(groups.where("group_key LIKE '%b%'"), ["org_name", "group_key"], "left_anti")


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf_dir):
    """Nearly equal spellings; a sequence-matcher ratio has no SQL, so tests hold this against all pairs."""
    return suppliers.fuzzy_pairs(spelled(spark, sf_dir))
