"""Token-ID output as bit-plane shuffled blocks.

Documents are range-partitioned and sorted by doc_id, encoded, closed with an end id and laid end to end. Each partition's stream is cut
into blocks of BLOCK ids; a block is transposed into byte planes (or bit planes) and each plane is compressed with zstandard. A block
row also lists the documents it holds, which together form the chunk index. The file format is Parquet rows (part, block, n, planes,
docs), so any store that Spark reads can hold it and a lost task rewrites only its own part.

Defined cases: null text encodes as the empty text (only the end id); null doc_ids sort first; rows with equal doc_id stay separate, in
text order; an empty table writes no block; other columns are ignored. Memory per task follows one block and one longest document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir
from .words import slices

BLOCK = 65_536
CACHE = 800_000  # pieces whose ids a Python worker remembers: about 200 bytes each
CHUNK = 6_000_000  # bytes of text that a task encodes at once
SCHEMA = "part int, block int, n long, planes array<binary>, docs array<struct<ord:long,doc_id:long,at:long,n:long>>"
#: White space other than space and newline, and control characters that libraries class differently.
_ODD_SPACE = "".join(c for c in map(chr, range(0x3001)) if c not in " \n" and (c.isspace() or ord(c) < 32 or 127 <= ord(c) < 161))
_ODD = "  | \n|\n |\n\n|[ \n]$|[" + "".join(rf"\x{{{ord(c):x}}}" for c in _ODD_SPACE) + "]"
_loaded: dict = {}


class _Encoder:
    """Ids of whole texts. The byte-level pre-tokenizer never joins a non-space to the white space after it, so a text cut before each
    single space or newline encodes piece by piece to the same ids; pieces repeat, so each is encoded once. Texts with runs of white
    space or with unusual white space are encoded whole.

    Ids of pieces are kept in two generations: when the young one holds half of CACHE it replaces the old one, and a piece found in the old
    one moves to the young one, so frequent pieces stay and memory is bounded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: its string has a character for each byte
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str], at_once: int = 50) -> list[bytes]:
        """The ids of pieces that each begin with white space: laid end to end they encode to their own ids, told apart by their bytes."""
        groups = [pieces[i : i + at_once] for i in range(0, len(pieces), at_once)]
        raw = b"".join(self.encode(["".join(g) for g in groups]))
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        cut = [0, *(4 * (np.searchsorted(np.cumsum(self.width[np.frombuffer(raw, np.uint32)]), ends) + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, which stand without their leading space."""
        found = list(map(self.young.get, pieces))
        lost = [i for i, x in enumerate(found) if x is None]
        for i in lost:
            found[i] = self.old.get(pieces[i])
        new = [pieces[i] for i in lost if found[i] is None]
        fresh = iter(self.encode_pieces([p if p[:1] == "\n" else " " + p for p in new]))
        for i in lost:
            if found[i] is None:
                found[i] = next(fresh)
        self.young.update((pieces[i], found[i]) for i in lost)
        if len(self.young) > CACHE // 2:
            self.young, self.old = {}, self.young
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column, end to end, and how many each text (null: empty) has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        # a text's first piece has no space before it: it (or all of an odd text) is encoded on its own
        heads = self.encode([t if o else h for t, o, h in zip(texts.to_pylist(), odd.tolist(), pc.list_element(lists, 0).to_pylist(), strict=True)] if odd.any() else pc.list_element(lists, 0).to_pylist())
        ids = self.known(coded.dictionary.to_pylist()) + heads
        piece = coded.indices.to_numpy().astype(np.int64)
        piece[first[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, size = (np.cumsum(size) - size)[piece], size[piece]
        ends = np.cumsum(size)
        out = np.frombuffer(b"".join(ids), np.uint32)[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.concatenate([[0], ends])[first])


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The compressed planes of a block of 32-bit ids, lowest first."""
    pack = zstandard.ZstdCompressor(level=3).compress
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        table = np.unpackbits(table, axis=1, bitorder="little")
        return [pack(np.packbits(table[:, i]).tobytes()) for i in range(32)]
    return [pack(np.ascontiguousarray(table[:, i]).tobytes()) for i in range(4)]


def unplanes(parts: list[bytes], n: int) -> np.ndarray:
    opened = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in parts]
    if len(parts) == 32:
        table = np.stack([np.unpackbits(p, count=n) for p in opened], axis=1)
        return np.packbits(table, axis=1, bitorder="little").view("<u4").ravel()
    return np.stack(opened, axis=1).reshape(-1).view("<u4")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block: int = BLOCK, bits: bool = False) -> None:
    """Writes the ids of docs (doc_id, text) under path, in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, _Encoder(tokenizer))
        part, number, order = TaskContext.get().partitionId(), 0, 0
        held, docs_in, size = [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("ord", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])))])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "n": size, "planes": planes(np.concatenate(held), bits), "docs": docs_in}], schema)

        for batch in batches:
            for rows in slices(batch, 1, CHUNK):
                flat, counts = encoder.batch(rows.column(1))
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(rows.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    x, at = np.append(flat[a:b], np.uint32(end_id)), 0
                    while at < len(x):
                        n = min(block - size, len(x) - at)
                        held.append(x[at : at + n])
                        docs_in.append({"ord": order, "doc_id": doc_id, "at": at, "n": n})
                        size, at = size + n, at + n
                        if size == block:
                            yield row()
                            held, docs_in, size, number = [], [], 0, number + 1
                    order += 1
        if size:
            yield row()

    n = partitions(docs.sparkSession)
    # the start of the text splits a doc_id that many rows have (or null) over several ranges
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA).write.parquet(path))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Decodes every block: one row for each part of a document in a block, with its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, at = unplanes(r["planes"], r["n"]), 0
                rows = []
                for d in r["docs"]:
                    rows.append({"part": r["part"], **d, "ids": ids[at : at + d["n"]].tobytes()})
                    at += d["n"]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]))

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(decode, "part int, ord long, doc_id long, at long, n long, ids binary")


def crc32_combine(a: int, b: int, n: int) -> int:
    """The crc32 of x + y from crc32(x), crc32(y) and len(y): x's register is carried over n zero bytes."""
    square = lambda m: [_times(m, v) for v in m]
    odd = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    m = square(square(square(odd)))  # one zero byte
    while n:
        if n & 1:
            a = _times(m, a)
        n, m = n >> 1, square(m)
    return a ^ b


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    @F.pandas_udf("long")
    def joined(n: pd.Series, crc: pd.Series) -> pd.Series:
        out = []
        for ns, crcs in zip(n, crc, strict=True):
            c = int(crcs[0])
            for m, x in zip(ns[1:], crcs[1:], strict=True):
                c = crc32_combine(c, int(x), 4 * int(m))
            out.append(c)
        return pd.Series(out, dtype="int64")

    pieces = read_pieces(spark, path).select("part", "ord", "doc_id", "at", "n", F.crc32("ids").alias("crc"))
    whole = pieces.groupBy("part", "ord").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))
    by_part = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n").alias("total"))  # one row for each file
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return whole.join(offsets, "part").select(
        "doc_id",
        (F.col("base") + F.coalesce(F.sum("n_tokens").over(by_part), F.lit(0))).alias("start"),
        "n_tokens",
        F.when(F.size("p") == 1, F.col("p.crc")[0]).otherwise(joined("p.n", "p.crc")).alias("ids_crc32"),
    )


def tokens_round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, **options)
    return token_digest(spark, path)


def brute_force(texts: list[tuple[int, str | None]], tokenizer: str, end_id: int = 0) -> list[tuple]:
    """The same result in plain Python, for tests."""
    from tokenizers import Tokenizer

    encoder, start, out = Tokenizer.from_file(tokenizer), 0, []
    for doc_id, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.asarray([*encoder.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out
