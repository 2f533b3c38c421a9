"""Item-name resolution: canonical names, and matching sales names to inventory names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import annotation_head, match_key, spelled_key

from .ordered import Fill, Total, in_order, plain

MIN_PREFIX = 10


def canonical(names: DataFrame, alias: DataFrame, name: str = "item") -> DataFrame:
    """names with `canonical`: the alias table's (session_id, variant, canonical) name, or the name itself."""
    a = alias.select("session_id", F.lower(F.trim("variant")).alias("variant_key"), "canonical")
    keyed = names.withColumn("variant_key", F.lower(F.trim(name)))
    return keyed.join(a, ["session_id", "variant_key"], "left").withColumn("canonical", F.coalesce("canonical", name)).drop("variant_key")


def prefixes(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """session_id, t, longest (the longest key that t starts with), n_whole (how many keys start with t), whole (the only one) for texts
    (session_id, t), none of which is a key (session_id, k); all of them hold a-z and 0-9 only.

    In sorted order a key k opens at k and closes behind all texts that start with it, so keys nest. A text's longest prefix is the key that
    opened last at the text's depth; the keys that start with it open between the text and its own close. Each key and text makes two rows,
    whatever its length, and a session's rows may lie in many tasks.
    """
    end = "~"  # sorts behind the letters of a match key
    row = lambda rows, at, kind, key, depth, t: rows.select("session_id", at.alias("at"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(depth).alias("step"), t.alias("t"))
    none, k, t = F.lit(None).cast("string"), F.col("k"), F.col("t")
    rows = row(keys, k, 0, k, 1, none).union(row(keys, F.concat(k, F.lit(end)), 2, none, -1, none)).union(row(texts, t, 1, none, 0, t)).union(row(texts, F.concat(t, F.lit(end)), 3, none, 0, t))
    rows = rows.withColumn("one", F.when(F.col("key").isNotNull(), 1))
    placed = plain(in_order(rows, ["session_id"], ["at", "kind"], {"depth": Total("step"), "n_keys": Total("one"), "last": Fill("key")}))
    texts_at = placed.where("kind IN (1, 3)").groupBy("session_id", "t").agg(
        F.max(F.when(F.col("kind") == 1, F.col("n_keys"))).alias("before"), F.max(F.when(F.col("kind") == 3, F.col("n_keys"))).alias("after"), F.max(F.when(F.col("kind") == 3, F.col("last"))).alias("last")
    )
    n = F.col("after") - F.col("before")
    whole = texts_at.select("session_id", "t", n.alias("n_whole"), F.when(n == 1, F.col("last")).alias("whole"))
    inner = placed.where("kind = 0 OR (kind = 1 AND depth > 0)").select("session_id", "depth", "at", "kind", "key", "t")
    longest = plain(in_order(inner, ["session_id", "depth"], ["at", "kind"], {"longest": Fill("key")})).where("kind = 1").select("session_id", "t", "longest")
    return whole.join(longest, ["session_id", "t"], "left")


def match_names(sales_names: DataFrame, inventory_names: DataFrame) -> DataFrame:
    """session_id, name, key, how for each distinct (session_id, name): the inventory key that a sales name stands for.

    In order: the same key; the longest inventory key (of MIN_PREFIX characters at least) that the name's key starts with; the only
    inventory key that starts with the name's key (two or more: the name is dropped, its key null); the same three for the name without
    its annotation; else its own unannotated key. A key may be the same by chance where words border elsewhere ("no 20 33" cut from
    "no 20 330", and "no 2 033"): a name that no inventory item is spelled like, but that items go on from as it is spelled, stands for
    these. Names without an equal key are looked up by `prefixes`, in one sorted pass over keys, and so are such spellings.
    """
    squeezed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    inv = inventory_names.select("session_id", spelled_key(F.col("item")).alias("w")).withColumn("k", squeezed("w")).where("k <> ''").distinct()
    keys = inv.select("session_id", "k").distinct()
    names = sales_names.select("session_id", "name").distinct().select("session_id", "name", spelled_key(F.col("name")).alias("w0"), spelled_key(annotation_head(F.col("name"))).alias("w1"))
    tries = names.select("session_id", F.explode(F.array_distinct(F.array("w0", "w1"))).alias("w")).where("w <> ''").distinct().withColumn("t", squeezed("w"))
    exact = tries.join(keys, (tries.session_id == keys.session_id) & (tries.t == keys.k), "left_semi").withColumn("exact", F.lit(True))
    open_tries = tries.join(exact.drop("exact"), ["session_id", "w", "t"], "left_anti").select("session_id", "t").distinct()
    odd = exact.where(F.length("t") >= MIN_PREFIX).join(inv, ["session_id", "w"], "left_anti").select("session_id", "w")
    # both kinds in one pass, told apart by their first character
    marked = lambda mark, df, c, name: df.select("session_id", F.concat(F.lit(mark), c).alias(name))
    all_keys = marked("0", keys.where(F.length("k") >= MIN_PREFIX), "k", "k").union(marked("1", inv.join(odd.select("session_id").distinct(), "session_id", "left_semi"), "w", "k"))
    found = prefixes(all_keys, marked("0", open_tries.where(F.length("t") >= MIN_PREFIX), "t", "t").union(marked("1", odd, "w", "t")))
    rest = lambda c: F.substring(c, 2, 1_000_000_000)
    found = found.select("session_id", F.substring("t", 1, 1).alias("mark"), rest("t").alias("t"), F.when(F.startswith("longest", F.lit("0")), rest("longest")).alias("longest"), "n_whole", rest("whole").alias("whole"))
    by_key = found.where("mark = '0'").drop("mark")
    respelled = found.where("mark = '1' AND n_whole > 0").select("session_id", F.col("t").alias("w"), F.col("n_whole").alias("n_on"), squeezed("whole").alias("on"))
    known = tries.join(exact, ["session_id", "w", "t"], "left").join(by_key, ["session_id", "t"], "left").join(respelled, ["session_id", "w"], "left")
    same = F.col("exact") & F.col("n_on").isNull()
    n = F.coalesce("n_on", "n_whole")
    found = known.select(
        "session_id", "w", F.when(same, "exact").when(F.col("longest").isNotNull(), "starts").when(n == 1, "cut").when(n > 1, "ambiguous").alias("how"),
        F.when(same, F.col("t")).when(F.col("exact"), F.col("on")).otherwise(F.coalesce("longest", F.col("whole"))).alias("key"),
    )
    side = lambda x: found.select("session_id", F.col("w").alias(f"w{x}"), F.col("how").alias(f"how_{x}"), F.col("key").alias(f"key_{x}"))
    both = names.join(side("0"), ["session_id", "w0"], "left").join(side("1"), ["session_id", "w1"], "left")
    how = F.coalesce("how_0", "how_1", F.lit("own"))
    key = F.when(F.col("how_0").isNotNull(), F.col("key_0")).when(F.col("how_1").isNotNull(), F.col("key_1")).otherwise(squeezed("w1"))
    return both.select("session_id", "name", key.alias("key"), how.alias("how"))


def two_stage_lookup(left: DataFrame, right: DataFrame, name: str, values: list[str]) -> DataFrame:
    """left with `values` of the right row of the same name, else of the first right row (by row_no) of the same match key."""
    exact = right.groupBy("session_id", F.col("name").alias(name)).agg(*[F.min_by(v, "row_no").alias(f"{v}_exact") for v in values])
    drift = right.groupBy("session_id", match_key(F.col("name")).alias("match_key")).agg(*[F.min_by(v, "row_no").alias(f"{v}_drift") for v in values])
    keyed = left.withColumn("match_key", match_key(F.col(name)))
    out = keyed.join(exact, ["session_id", name], "left").join(drift, ["session_id", "match_key"], "left")
    return out.select(*left.columns, *[F.coalesce(f"{v}_exact", f"{v}_drift").alias(v) for v in values])


def in_scope(inventory: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of inventory (session_id, item, canonical) whose canonical key is among top (session_id, key); in sessions without such a row
    those whose own key is; in sessions without these either, all."""
    hit = lambda x: top.select("session_id", F.col("key").alias(f"key_{x}")).distinct().withColumn(f"hit_{x}", F.lit(True))
    keyed = inventory.withColumns({"key_a": match_key(F.col("canonical")), "key_b": match_key(F.col("item"))})
    found = keyed.join(hit("a"), ["session_id", "key_a"], "left").join(hit("b"), ["session_id", "key_b"], "left")
    how = found.groupBy("session_id").agg(F.when(F.count("hit_a") > 0, "canonical").when(F.count("hit_b") > 0, "own").otherwise("all").alias("how"))
    keep = F.when(F.col("how") == "canonical", F.col("hit_a")).when(F.col("how") == "own", F.col("hit_b")).otherwise(True)
    return found.join(how, "session_id").where(keep).select(*inventory.columns)
