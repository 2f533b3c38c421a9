"""Line dedup by content-defined chunks (DataFrame functions only).

A text is split at newlines. Each line has a hash; a rolling hash over two consecutive line hashes closes a chunk after a line whenever it
is 0 modulo EVERY, so boundaries depend on nearby lines only and survive insertions before them. A chunk of at least MIN_LINES lines that
occurs more than once in the corpus is kept at its first place (smallest doc_id, then position) and removed everywhere else. Chunks are
counted by hash first; only chunks with a repeated hash are then compared byte for byte.

Defined cases: null text has no lines and gives a null text; a null doc_id counts as the smallest; rows with the same doc_id count as one
document, so a chunk stays in each of them unless an earlier document has it; single-line chunks are never removed; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

EVERY, MIN_LINES = 4, 2
HOT, SALTS = 4096, 64
_NO_ID = -(2**63)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _held(c: Column) -> Column:
    """c computed once a row: a one-row generator, into which later projections are not folded."""
    return F.explode(F.array(c))


def chunked(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """id (doc_id; null: the smallest long), row (a hash of all chunks), chunks: array<struct<text, n, hash>>: each text's chunks in order,
    their lines joined by newlines."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held(F.split("text", "\n", -1)).alias("lines"))
    hashed = lines.select("doc_id", "lines", _held(F.transform("lines", _line_hash)).alias("h"))
    closes = lambda x, i: ((i >= 1) & ((F.get("h", i - 1) * 3 + x) % every == 0)) | (i == F.size("h") - 1)
    ends = F.filter(F.transform("h", lambda x, i: F.when(closes(x, i), i)), lambda i: i.isNotNull())
    cut = hashed.select("doc_id", "lines", _held(ends).alias("ends"))
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("ends", j - 1) + 1)
    piece = lambda e, j: F.struct(F.array_join(F.slice("lines", start(j) + 1, e - start(j) + 1), "\n").alias("text"), (e - start(j) + 1).cast("long").alias("n"))
    cut = cut.select("doc_id", _held(F.transform("ends", piece)).alias("chunks"))
    cut = cut.select("doc_id", _held(F.transform("chunks", lambda c: F.struct(c["text"].alias("text"), c["n"].alias("n"), F.xxhash64(c["text"]).alias("hash")))).alias("chunks"))
    return cut.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("chunks.hash").alias("row"), "chunks")


def _salted(df: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """df with salt: of rows whose hash is in the broadcast table hot, the given one, else 0."""
    return df.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, every: int = EVERY) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks_removed, text (what is kept) for each row of docs (doc_id, text).

    Chunks are counted by hash alone; then the texts of chunks with a repeated hash, and no others, are grouped byte by byte. A hash that has
    more than 1/HOT of all repeated chunks (so there are fewer than HOT) is spread over SALTS keys wherever its rows meet."""
    cut = chunked(docs, every)
    places = cut.select("id", "row", F.posexplode("chunks").alias("pos", "c")).where(F.col("c.n") >= min_lines).select("id", "row", "pos", F.col("c.hash").alias("hash"))
    hashes = durable(places.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1"), "hashes")
    total = hashes.agg(F.sum("k")).first()[0] or 0
    hot = hashes.where(F.col("k") > total / HOT).select("hash", F.lit(True).alias("hot"))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    every_salt = lambda df: df.join(F.broadcast(hot), "hash", "left").withColumn("salt", salts).drop("hot")
    own = F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int")
    some = _salted(places, hot, own).join(every_salt(hashes.select("hash")), ["hash", "salt"], "left_semi")
    wanted = durable(some.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "hash", "salt")).alias("at")), "wanted")
    # cut meets both joins in one plan with the same key and columns, so its shuffle is made once and reused
    texts = cut.join(wanted, ["id", "row"]).select("id", "row", _held(F.transform("at", lambda a: F.struct(a["pos"].alias("pos"), a["hash"].alias("hash"), a["salt"].alias("salt"), F.get("chunks", a["pos"])["text"].alias("text")))).alias("at"))
    each = texts.select("id", "row", F.inline("at"))
    repeated = each.groupBy("hash", "text").agg(F.count("*").alias("k"), F.min("id").alias("first_doc")).where("k > 1").drop("k")
    met = each.join(every_salt(repeated), ["hash", "salt", "text"])
    # of a chunk that a text of the first document has several times, the first stays
    by_chunk = met.groupBy("id", "row", "hash", "text", (F.col("id") == F.col("first_doc")).alias("first")).agg(F.collect_set("pos").alias("pos"), F.min("pos").alias("least"))
    gone = by_chunk.select("id", "row", F.when(F.col("first"), F.filter("pos", lambda p: p != F.col("least"))).otherwise(F.col("pos")).alias("pos"))
    gone = gone.groupBy("id", "row").agg(F.flatten(F.collect_set("pos")).alias("gone"))
    out = cut.join(gone, ["id", "row"], "left").select("id", "chunks", _held(F.coalesce("gone", F.array().cast("array<int>"))).alias("gone"))
    # array_except hashes, so this is linear in the chunks of a text
    all_places = F.when(F.size("chunks") > 0, F.sequence(F.lit(0), F.size("chunks") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "chunks", "gone", _held(F.transform(F.array_except(all_places, "gone"), lambda i: F.get("chunks", i))).alias("kept"))
    count = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c["n"]), F.lit(0).cast("long"))
    whole = F.col("chunks").isNotNull()
    return out.select(
        "doc_id", count("chunks").alias("n_lines"), (count("chunks") - F.when(whole, count("kept")).otherwise(0)).alias("n_removed"), F.size("gone").cast("long").alias("n_chunks_removed"),
        F.when(whole, F.array_join(F.transform("kept", lambda c: c["text"]), "\n")).alias("text"),
    )


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
b AS (SELECT *, lag(h) OVER w AS before, lead(i) OVER w IS NULL AS last FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CASE WHEN (before IS NOT NULL AND (before * 3 + h) % {EVERY} = 0) OR last THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
t AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM c GROUP BY doc_id, chunk),
m AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY body, n >= {MIN_LINES} ORDER BY doc_id, chunk) > 1 AS gone FROM t)
SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (gone) AS BIGINT) AS n_chunks_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""
