"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix and written in another order between sentinels.

Cuts fall between units: tokens (a run of A-Z, a-z, or any other single character) or characters. A batch of texts is kept as its UTF-8
bytes. A sparse exception index holds only the multibyte characters: their byte places and the bytes that they have beyond one. Code points
and bytes are turned into each other by searchsorted on it; between exceptions, in ASCII spans, the two differ by a constant.

Defined cases: null text counts as empty, and an empty text stays plain, as do texts that contain a sentinel; a null key is hashed as the
empty string; equal rows give equal results; other columns are ignored; an empty table gives no row. No shuffle; a task holds about CHUNK
bytes of text, or one longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .words import slices

SENTINELS = ("<P>", "<S>", "<M>")
CHUNK = 2_000_000
CUT_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: The same rows in DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS p FROM documents),
h AS (SELECT *, len(p) AS n, ('0x' || hex[1:8])::UBIGINT AS h1, ('0x' || hex[9:16])::UBIGINT AS h2, ('0x' || hex[17:24])::UBIGINT AS h3, ('0x' || hex[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, coalesce(array_to_string(p[1:a], ''), '') AS pre, coalesce(array_to_string(p[a + 1:b], ''), '') AS mid, coalesce(array_to_string(p[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256
FROM s
"""


class Exceptions:
    """The multibyte characters of some UTF-8 bytes: their byte places, and the excess bytes up to each of them."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.zeros(len(self.at) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        self.char_at = self.at - self.excess[:-1]

    def chars(self, places: np.ndarray) -> np.ndarray:
        """How many code points begin before each byte place (a border of characters)."""
        return places - self.excess[np.searchsorted(self.at, places)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """The byte place of each code point."""
        return chars + self.excess[np.searchsorted(self.char_at, chars)]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte places at which the tokens of texts, laid end to end, begin."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    inside = letter[1:] & letter[:-1]
    border = offsets[(offsets > 0) & (offsets < len(data))]
    inside[border - 1] = False
    begins[1:] &= ~inside
    return np.flatnonzero(begins)


def _hashes(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", sentinels: tuple[str, str, str] = SENTINELS, unit: str = "tokens", rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), the code points and bytes of prefix and middle (null if plain), output.

    Of the documents that can be cut, rate in 100 are, and of these spm in 100 begin with the suffix; a keyed hash decides, so a rerun
    agrees. sentinels mark prefix, suffix and middle; the end of none may begin another, so that an output is read back in one way only.
    """
    if any(a and (a != s or s != t) and t.startswith(a) for s in sentinels for t in sentinels for a in (s[i:] for i in range(len(s)))) or not all(sentinels):
        raise ValueError("the end of a sentinel begins a sentinel")
    if unit not in ("tokens", "chars"):
        raise ValueError("unit is tokens or chars")
    p, s, m = (x.encode() for x in sentinels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1, CHUNK):
                yield _cut(rows)

    def _cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).cast(pa.large_binary())
        _, places, raw = texts.buffers()
        ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        index, n_rows = Exceptions(data), len(texts)
        base = index.chars(ends)
        if unit == "tokens":
            starts = np.append(unit_starts(data, ends), len(data))
            first = np.searchsorted(starts[:-1], ends)
        n = np.diff(first if unit == "tokens" else base)
        h = np.stack([rows.column(i).to_numpy() for i in (2, 3)]) % (n + 1)

        def place(units: np.ndarray) -> np.ndarray:
            byte = starts[first[:-1] + units] if unit == "tokens" else index.bytes(base[:-1] + units)
            return np.where(units == n, ends[1:], byte)

        a, b = place(h.min(axis=0)), place(h.max(axis=0))
        prefix_chars, middle_chars = index.chars(a) - base[:-1], index.chars(b) - index.chars(a)
        forms = rows.column(4).to_pylist()
        view, out = data.tobytes(), []
        for f, i, x, y, j in zip(forms, ends[:-1].tolist(), a.tolist(), b.tolist(), ends[1:].tolist(), strict=True):
            if f == "plain":
                out.append(view[i:j])
            elif f == "psm":
                out.append(b"".join((p, view[i:x], s, view[y:j], m, view[x:y])))
            else:
                out.append(b"".join((s, view[y:j], p, view[i:x], m, view[x:y])))
        plain = np.fromiter((f == "plain" for f in forms), bool, n_rows)
        spans = [pa.array(v, pa.int64(), mask=plain) for v in (prefix_chars, middle_chars, a - ends[:-1], b - a)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), rows.column(4), *spans, pa.array(out, pa.string())], names=[x.split()[0] for x in CUT_SCHEMA.split(", ")])

    form = F.when((F.col("text") == "") | F.contains("text", F.lit(sentinels[0])) | F.contains("text", F.lit(sentinels[1])) | F.contains("text", F.lit(sentinels[2])) | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"), *_hashes(key, seed))
    return rows.select("doc_id", "text", "h1", "h2", form.alias("form")).mapInArrow(cut, CUT_SCHEMA)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output, by its form."""
    parts = F.split(F.col(output), "|".join(rf"\Q{x}\E" if re.search(r"\W", x) else x for x in sentinels), -1)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digest(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], unit: str = "tokens") -> list[tuple]:
    """doc_id, n, form, prefix_chars, middle_chars, output in plain Python, for tests."""
    import hashlib

    out = []
    for key, text in rows:
        x = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", x) if unit == "tokens" else list(x)
        digits, n = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest(), len(units)
        h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not x or any(s in x for s in SENTINELS) or h3 % 100 >= 90:
            out.append((key, n, "plain", None, None, x))
        elif h4 % 100 < 20:
            out.append((key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"))
        else:
            out.append((key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"))
    return out
