"""The supplier directory: one spelling for each supplier of an organisation, merges, duplicate suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import match_key, removed_words

from . import suppliers
from .components import components

DEFAULT_DELAY, DEFAULT_QUALITY, UNRELIABLE = 0.2, 0.3, 0.35


def source_rank(c: Column) -> Column:
    """Trust in where a name was seen: a listing over purchase orders over sales."""
    return F.when(c == "listing", 2).when(c == "po", 1).otherwise(0)


def source_union(names: DataFrame) -> DataFrame:
    """org_name, supplier, source: each distinct name with its best source."""
    return names.where(F.trim("supplier") != "").groupBy("org_name", F.trim("supplier").alias("supplier")).agg(F.max_by("source", source_rank(F.col("source"))).alias("source"))


def rebuild(found: DataFrame, existing: DataFrame) -> DataFrame:
    """org_name, supplier, source, merged_into: the directory after a rebuild from found (org_name, supplier, source).

    Names of one match key are one supplier. The spelling on record stays, unless it was not found again or a longer one was (white space
    runs count once; ties: the first by name). Sources only rise, except with a new spelling. What was merged into an old spelling follows."""
    size = F.length(F.regexp_replace(F.trim("supplier"), r"\s+", " "))
    keyed = found.withColumn("key", match_key(F.col("supplier")))
    longest = keyed.groupBy("org_name", "key").agg(F.min_by("supplier", F.struct(-size, "supplier")).alias("longest"), F.max(size).alias("longest_size"), F.max_by("source", source_rank(F.col("source"))).alias("best"), F.collect_set("supplier").alias("seen"))
    old = existing.groupBy("org_name", match_key(F.col("supplier")).alias("key")).agg(F.max(F.struct(F.col("supplier").alias("old"), F.col("source").alias("old_source"), "merged_into")).alias("o")).select("org_name", "key", "o.*")
    both = longest.join(old, ["org_name", "key"], "full_outer")
    old_size = F.length(F.regexp_replace(F.trim("old"), r"\s+", " "))
    name = F.when(F.col("longest").isNull(), F.col("old")).when(F.array_contains("seen", F.col("old")) & (F.col("longest_size") <= old_size), F.col("old")).otherwise(F.col("longest"))
    risen = F.when(source_rank(F.col("best")) > source_rank(F.col("old_source")), F.col("best")).otherwise(F.col("old_source"))
    source = F.when(F.col("old").isNull() | (F.col("longest").isNotNull() & (F.col("supplier") != F.col("old"))), F.col("best")).when(F.col("longest").isNull(), F.col("old_source")).otherwise(risen)
    now = both.withColumn("supplier", name).select("org_name", "supplier", source.alias("source"), "merged_into", "old")
    renamed = now.where("old <> supplier").select("org_name", F.col("old").alias("merged_into"), F.col("supplier").alias("to"))
    return now.drop("old").join(renamed, ["org_name", "merged_into"], "left").select("org_name", "supplier", "source", F.coalesce("to", "merged_into").alias("merged_into"))


def apply_actions(directory: DataFrame, actions: DataFrame) -> DataFrame:
    """directory after merge / unmerge actions (org_name, supplier, action, target, at): the latest action of a name decides; a name that
    others are merged into is not merged itself if it was made a target last, and chains collapse to their end by one step."""
    latest = actions.groupBy("org_name", "supplier").agg(F.max_by(F.struct("action", "target"), "at").alias("a"), F.max("at").alias("at"))
    chosen = actions.where("action = 'merge'").groupBy("org_name", F.col("target").alias("supplier")).agg(F.max("at").alias("target_at"))
    names = directory.select("org_name", "supplier", "source", "merged_into").join(latest, ["org_name", "supplier"], "full_outer").join(chosen, ["org_name", "supplier"], "left")
    into = F.when(F.col("a.action") == "merge", F.col("a.target")).when(F.col("a").isNotNull(), None).otherwise(F.col("merged_into"))
    free = F.col("target_at").isNotNull() & (F.col("at").isNull() | (F.col("target_at") > F.col("at")))
    now = names.select("org_name", "supplier", F.coalesce("source", F.lit("manual")).alias("source"), F.when(~free, into).alias("merged_into"))
    now = now.withColumn("merged_into", F.when(F.col("merged_into") != F.col("supplier"), F.col("merged_into")))
    step = now.where("merged_into IS NOT NULL").select("org_name", F.col("supplier").alias("merged_into"), F.col("merged_into").alias("end"))
    return now.join(step, ["org_name", "merged_into"], "left").select("org_name", "supplier", "source", F.coalesce("end", "merged_into").alias("merged_into"))


def duplicate_groups(names: DataFrame) -> DataFrame:
    """org_name, group_key, supplier, reason: names of an organisation that are probably one supplier. Groups of equal names without legal
    words and pairs of nearly equal spellings are joined by what they share; the first kind gives the reason where both apply."""
    distinct = names.where(F.trim("supplier") != "").select("org_name", "supplier").distinct()
    stems = suppliers.suffix_groups(distinct)
    members = stems.select("org_name", F.col("names")[0].alias("first"), F.explode("names").alias("supplier"), "removed")
    said = F.when(F.size("removed") > 0, F.concat(F.lit("same name after removing "), F.array_join(F.transform("removed", F.upper), ", "))).otherwise("same name ignoring spacing and punctuation")
    by_key = distinct.groupBy("org_name", match_key(F.col("supplier")).alias("key")).agg(F.min("supplier").alias("first"), F.collect_list("supplier").alias("names"))
    pairs = suppliers.fuzzy_pairs(distinct)
    side = lambda x: by_key.select("org_name", F.col("key").alias(x), F.col("first").alias(f"first_{x}"), F.col("names").alias(f"names_{x}"))
    near = pairs.join(side("a"), ["org_name", "a"]).join(side("b"), ["org_name", "b"])
    spelled = near.select("org_name", F.col("first_a").alias("first"), F.explode(F.concat("names_a", "names_b")).alias("supplier"))
    node = lambda c: F.concat_ws("\0", "org_name", c)
    edges = members.select(node("first").alias("a"), node("supplier").alias("b")).union(spelled.select(node("first").alias("a"), node("supplier").alias("b")))
    reasons = members.select(node("supplier").alias("id"), F.lit(0).alias("rank"), said.alias("reason")).union(spelled.select(node("supplier").alias("id"), F.lit(1).alias("rank"), F.lit("spelled almost the same").alias("reason")))
    reason = reasons.groupBy("id").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))
    found = components(edges.where("a <> b")).join(reason, "id")
    org, name = (lambda c: F.split(c, "\0")[0]), (lambda c: F.split(c, "\0")[1])
    return found.select(org("id").alias("org_name"), match_key(name("component")).alias("group_key"), name("id").alias("supplier"), "reason")


def suggestions(directory: DataFrame, ignored: DataFrame) -> DataFrame:
    """Duplicate groups of the names that are not merged, without those that were dismissed (org_name, group_key)."""
    return duplicate_groups(directory.where("merged_into IS NULL").select("org_name", "supplier")).join(ignored.select("org_name", "group_key").distinct(), ["org_name", "group_key"], "left_anti")


def profile_resolve(names: DataFrame, directory: DataFrame, profiles: DataFrame) -> DataFrame:
    """names (org_name, supplier) with the profile of the name they are merged into, or defaults; unreliable suppliers are marked."""
    to = directory.where("merged_into IS NOT NULL").select("org_name", "supplier", F.col("merged_into").alias("to"))
    j = names.join(to, ["org_name", "supplier"], "left").withColumn("profile", F.coalesce("to", "supplier"))
    p = profiles.select("org_name", F.col("supplier").alias("profile"), "delay_probability", "avg_lead_time_days", "data_quality_score", F.lit(True).alias("found"))
    j = j.join(p, ["org_name", "profile"], "left")
    delay = F.when(F.col("found"), F.col("delay_probability")).otherwise(DEFAULT_DELAY)
    quality = F.when(F.col("found"), F.col("data_quality_score")).otherwise(DEFAULT_QUALITY)
    return j.select("org_name", "supplier", "profile", delay.alias("delay"), F.col("avg_lead_time_days").alias("lead_days"), quality.alias("quality"), F.coalesce(delay > UNRELIABLE, F.lit(False)).alias("unreliable"))


def directory_rows(directory: DataFrame, profiles: DataFrame, hidden: bool = False) -> DataFrame:
    """org_name, supplier, source, merged_names, total_recs, unreliable, archived: the supplier page. Merged names are listed under the name
    they are merged into; profiles that no upload has mentioned follow without a source; archived ones only if hidden."""
    merged = directory.where("merged_into IS NOT NULL").groupBy("org_name", F.col("merged_into").alias("supplier")).agg(F.array_sort(F.collect_list("supplier")).alias("merged_names"))
    p = profiles.select("org_name", "supplier", "total_recs", "delay_probability", F.coalesce("archived", F.lit(False)).alias("archived"))
    seen = directory.where("merged_into IS NULL").select("org_name", "supplier", "source").join(p, ["org_name", "supplier"], "left")
    own = p.where("supplier <> 'Unknown'").join(directory.where("merged_into IS NULL"), ["org_name", "supplier"], "left_anti").withColumn("source", F.lit(None).cast("string"))
    rows = seen.unionByName(own).join(merged, ["org_name", "supplier"], "left")
    shown = rows if hidden else rows.where(~F.coalesce("archived", F.lit(False)))
    return shown.select(
        "org_name", "supplier", "source", F.coalesce("merged_names", F.array().cast("array<string>")).alias("merged_names"), F.coalesce("total_recs", F.lit(0)).cast("bigint").alias("total_recs"),
        F.coalesce(F.col("delay_probability") > UNRELIABLE, F.lit(False)).alias("unreliable"), F.coalesce("archived", F.lit(False)).alias("archived"),
    )
