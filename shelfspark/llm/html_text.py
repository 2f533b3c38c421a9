"""Main text of web pages by a host suffix array.

A page is parsed into blocks of visible text. Each block belongs to a region: the chain of container elements, with their classes, that it
stands in (`body/nav.menu`, `body/article`; numbers in class names count as one, so `post-17` and `post-18` are one region). The token streams of a host's pages are laid end to end, region by region, and their suffixes
are sorted; neighbours that share RUN words (or all of a shorter region) and come from distinct pages are repeats. Pages with the same main
region count as one page, so copies and reprints repeat nothing.

What repeats cover decides regions, on every page: on each host, and for regions that are rare there over all hosts, the share of a region's
suffixes that repeat is held against that of the main region (the one with most suffixes that do not). Markedly above it, the region is
boilerplate and goes; a region with much text that hardly repeats is unique and stays; the main region stays. Only ties (too little text to
tell, or in between) are broken by structure: names of page furniture go, article and main stay, others stay on pages without these. A region
goes or stays whole, so a passage that two articles quote is not lost. Forms, scripts, styles and reader comments are no text of a page by
its markup: no repeats are needed to drop them (a form that never ends hides nothing but its controls). Class names of elements inside a
line, and of article and main, never drop words.

Regions on fewer than one in COMMON pages of their host (names made for a page, say) are ties: so a host has at most COMMON times as many
decided regions as a page has regions.

A host of up to HOST_BYTES of html is one suffix array in one task. A larger host has its suffixes, cut to RUN words, partitioned by their
hash into tasks of bounded size instead, so that equal ones still meet and are sorted there; both ways count the same repeats. Counts are one
row a host and region.

Defined cases: null html is an empty page; a page without visible text, or with boilerplate alone, gives an empty text; a null url belongs
to the empty host; repeated rows are separate pages with equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import chunks, mix, slices, window_hashes

RUN, HOST_BYTES = 8, 6_000_000
#: Bytes of the hashes of suffixes, which only meet in their bucket of some 100,000, and of pages, which only tell those of equal suffixes apart.
KEY, PAGE = 6, 3
#: Suffixes that a host needs to judge a region by itself; repeats that make boilerplate; their least share, and times the main region's.
ENOUGH, FEWEST, LEAST, TIMES = 200, 5, 0.05, 3.0
#: Suffixes that make a region unique if hardly any (this share) repeat.
MANY, HARDLY = 1000, 0.01
CHUNK = 2_000_000  # bytes that a task parses or cuts at once
LONG = 300  # characters of a region's name, beyond which a hash stands for it
COMMON = 100
# Elements and class names.
HIDDEN = frozenset("script style noscript template iframe svg canvas object button select textarea dialog head title annotation annotation-xml".split())
COMMENTS = frozenset("comment comments comment-list commentlist replies disqus".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "script style noscript template iframe svg canvas object button select textarea input "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle semantics annotation annotation-xml".split()
)
#: Elements that end where a like one begins, and the others that end them too.
ENDED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("body main article section nav aside header footer div menu table details".split())
MAIN = frozenset(("article", "main"))
FURNITURE = frozenset(
    "nav header footer aside menu ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar navbar navigation breadcrumb breadcrumbs "
    "masthead cookie cookies cookie-banner consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager skip-link".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar".split())
_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")


class _Blocks(HTMLParser):
    """Collects (region, text) blocks and, of each region, the kind that its names tell: 1 main text, -1 furniture, 0 open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int, bool, int]] = []  # element, region, kind, hidden, its form
        self.depth: dict[str, int] = {}  # how many of an element are open
        self.parts: list[str] = []
        self.found: list[tuple[str, int, str, int]] = []
        self.forms, self.ended = 0, {0}
        self.at = ("", 0, 0)

    def close_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append((self.at[0], self.at[1], text, self.at[2]))
        self.parts = []

    def result(self) -> tuple[list[tuple[str, str]], dict[str, int]]:
        self.close_block()
        shown = [x for x in self.found if x[3] == 0 or x[3] not in self.ended]
        return [(region, text) for region, _, text, _ in shown], {region: kind for region, kind, _, _ in shown}

    def pop(self, keep_form: bool = False) -> None:
        tag, *_, form = self.open.pop()
        self.depth[tag] -= 1
        if tag == "form" and not keep_form:
            self.ended.add(form)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.close_block()
            while self.open and (self.open[-1][0] == "p" or self.open[-1][0] in ENDED_BY_LIKE.get(tag, ())):
                self.pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, region, kind, hidden, form = self.open[-1] if self.open else ("", "", 0, False, 0)
        if not hidden:
            a = dict(attrs)
            role, names = (a.get("role") or "").lower(), f"{a.get('class') or ''} {a.get('id') or ''}".lower().split()
            hidden = tag in HIDDEN or "hidden" in a
            if tag == "form" or (role == "form" and tag not in INLINE):
                self.forms += 1
                form = self.forms
                if tag != "form":
                    self.ended.add(form)
            if tag not in INLINE:
                hidden = hidden or role == "dialog" or any(n in COMMENTS for n in names)
                was, main = kind, tag in MAIN or role == "main"
                furniture = tag in FURNITURE or role in ROLES or (not main and any(n in FURNITURE for n in names))
                if tag not in ("html", "body") and kind >= 0:
                    kind = -1 if furniture else 1 if main else kind
                if tag in CONTAINERS or kind != was:
                    region = f"{region}/{'.'.join((tag, *_DIGITS.sub('#', (a.get('class') or '').lower()).split()))}"
                    if len(region) > LONG:
                        region = blake2b(region.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.open.append((tag, region, kind, hidden, form))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.close_block()
        if self.depth.get(tag, 0):  # each element is opened and closed once, so all end tags take linear time
            last = False
            while not last:
                last = self.open[-1][0] == tag
                self.pop(keep_form=tag in ("body", "html"))

    def handle_data(self, data: str) -> None:
        _, region, kind, hidden, form = self.open[-1] if self.open else ("", "", 0, False, 0)
        if not hidden:
            if self.at[0] != region or self.at[2] != form:
                self.close_block()
            self.at = (region, kind, form)
            self.parts.append(data)


def blocks(html: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.result()


def regions(html: str) -> tuple[dict[str, list[str]], int]:
    """The texts of each region of a page, and a hash of its longest region, by which pages are told apart."""
    out: dict[str, list[str]] = {}
    for region, text in blocks(html)[0]:
        out.setdefault(region, []).append(text)
    most = max(("\n".join(x) for x in out.values()), key=len, default="")
    return out, int.from_bytes(blake2b(most.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def suffix_order(token: np.ndarray, ends: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `run` tokens, LCP of each with the one before it, at most `run`) of streams laid end to end.

    ends: the end of each token's stream; a suffix ends with its stream. Ranks of 1, 2, 4, ... tokens double by pairing, as in prefix
    doubling; the end of a stream ranks before all tokens.
    """
    n = len(token)
    rank, have = np.unique(token, return_inverse=True)[1].astype(np.int64) + 1, 1
    ranks = [(1, rank)]
    at = np.arange(n)
    while have < run:
        step = min(have, run - have)
        behind = np.where(at + step < ends, rank[np.minimum(at + step, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        have += step
        ranks.append((have, rank))
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    if n:
        left = np.minimum(ends - at, run)
        for length, r in ranks:  # the deepest ranks that agree; a whole shorter suffix agrees over its length
            same = np.concatenate([[False], r[order][1:] == r[order][:-1]])
            lcp = np.where(same, np.minimum(length, left[order]), lcp)
    return order, lcp


def repeated(token: np.ndarray, stream: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks of the suffixes whose first `run` tokens (all of a shorter stream) another page (by `page`, one number a token) has too.

    Only suffixes with `run` tokens left count, and the whole of shorter streams; others are never marked.
    """
    n = len(token)
    if not n:
        return np.zeros(0, bool)
    last = np.concatenate([stream[1:] != stream[:-1], [True]])
    ends = np.flatnonzero(last)[np.cumsum(last) - last] + 1
    order, lcp = suffix_order(token, ends, run)
    need = np.minimum(ends - np.arange(n), run)[order]
    group = np.cumsum(~((lcp >= need) & np.concatenate([[False], need[1:] == need[:-1]])))
    some = counted(stream, run)[order]  # tails of streams are in order too, but only others count
    order, group = order[some], group[some]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    p = page[order]
    two = np.minimum.reduceat(p, head) != np.maximum.reduceat(p, head)
    out = np.zeros(n, bool)
    out[order] = np.repeat(two, np.diff(np.append(head, len(order))))
    return out


def counted(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks of the suffixes that count: `run` tokens are left of their stream, or it is shorter and they are all of it."""
    n = len(stream)
    if not n:
        return np.zeros(0, bool)
    first = np.concatenate([[True], stream[1:] != stream[:-1]])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, size)
    return place <= np.repeat(np.maximum(size - run, 0), size)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _region_rows(pages: DataFrame) -> DataFrame:
    """host, region (a hash), page (a hash), text: the regions of each page (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1, CHUNK)):
            row, names, said, texts = [], [], [], []
            for i, html in enumerate(batch["html"].to_pylist()):
                found, page = regions(html or "")
                for name, x in found.items():
                    row.append(i)
                    names.append(name)
                    said.append(page)
                    texts.append("\n".join(x))
            yield pa.RecordBatch.from_arrays([batch["host"].take(pa.array(row, pa.int64())), pa.array(names, pa.string()), pa.array(said, pa.int64()), pa.array(texts, pa.string())], ["host", "region", "page", "text"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, region string, page long, text string")
    return rows.select(F.xxhash64("host").alias("host"), "region", "page", "text")


def _streams(table: pa.Table) -> Iterator[tuple]:
    """(words, stream, page, region) of a table of regions, chunk by chunk; one number a word, salted by region."""
    coded = table["region"].combine_chunks().dictionary_encode()
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    page = table["page"].to_numpy()
    for w in chunks(table["text"].combine_chunks(), 1 << 40):
        stream = np.repeat(w.rows, w.counts)
        yield w, mix(w.hashes(lower=False) ^ salt[stream]), stream, page[stream]


def _counts(table: pa.Table, run: int) -> pa.Table:
    """host, region, suffixes, repeats, pages of one host's regions, by one suffix array."""
    host, names = table["host"][0], np.array(table["region"].to_pylist(), object)
    kinds, of = np.unique(names, return_inverse=True)
    all_, hit = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    for _, token, stream, page in _streams(table):
        marks = counted(stream, run)
        all_ += np.bincount(of[stream[marks]], minlength=len(kinds))
        hit += np.bincount(of[stream[repeated(token, stream, page, run)]], minlength=len(kinds))
    return pa.table({"host": pa.array([host.as_py()] * len(kinds), pa.int64()), "region": pa.array(kinds, pa.string()), "suffixes": all_, "repeats": hit, "pages": np.bincount(of, minlength=len(kinds))})


def _dealt(rows: DataFrame, run: int) -> DataFrame:
    """host, region, bucket, keys, pages, rows: the suffixes of rows (host, region, page, text, buckets), cut to `run` words, as packed hashes;
    the first bucket of a region has the number of its rows."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 3, CHUNK)):
            buckets = batch["buckets"].to_numpy().astype(np.uint64)
            of = pd.factorize(pd.MultiIndex.from_arrays([batch["host"].to_numpy(), batch["region"].to_pylist()]))[0]
            for w, token, stream, page in _streams(pa.Table.from_batches([batch])):
                at = np.flatnonzero(counted(stream, run))
                row = stream[at]
                key = window_hashes(token, at, np.minimum(np.cumsum(w.counts)[row] - at, run))
                bucket = (key >> np.uint64(40)) % buckets[row]
                order = np.lexsort((bucket, of[row]))
                group, b = of[row][order], bucket[order]
                head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (b[1:] != b[:-1])])) if len(order) else order
                ends = np.append(head[1:], len(order))
                pack = lambda x: pa.array([x[a:e].tobytes() for a, e in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())  # noqa: E731, B023
                low = lambda x, n: np.ascontiguousarray(x[order].view(np.uint8).reshape(-1, 8)[:, :n])  # noqa: E731, B023
                first = pa.array(row[order][head])
                rows_of, opens = np.bincount(of), np.concatenate([[True], np.diff(group[head]) != 0])[: len(head)]
                yield pa.RecordBatch.from_arrays(
                    [batch["host"].take(first), batch["region"].take(first), pa.array(b[head].astype(np.int64)), pack(low(key, KEY)), pack(low(page[at], PAGE)), pa.array(np.where(opens, rows_of[group[head]], 0), pa.int64())], ["host", "region", "bucket", "keys", "pages", "rows"]
                )

    return rows.mapInArrow(run_batches, "host long, region string, bucket long, keys binary, pages binary, rows long")


def _bucket_counts(table: pa.Table) -> pa.Table:
    """host, region, suffixes, repeats, pages of one bucket of a region's suffixes."""

    def whole(name: str, n: int) -> np.ndarray:
        packed = np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, n)
        return np.pad(packed, ((0, 0), (0, 8 - n))).view(np.uint64).ravel()

    key, page = whole("keys", KEY), whole("pages", PAGE)
    order = np.argsort(key)
    k, p = key[order], page[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    two = np.minimum.reduceat(p, head) != np.maximum.reduceat(p, head)
    return pa.table({"host": table["host"][:1], "region": table["region"][:1], "suffixes": [len(key)], "repeats": [int(np.diff(np.append(head, len(key)))[two].sum())], "pages": [sum(table["rows"].to_pylist())]})


def repeats(pages: DataFrame, run: int = RUN, host_bytes: int = HOST_BYTES) -> DataFrame:
    """host, region, suffixes, repeats, pages, host_pages: of each region on each host of pages (host, html), its suffixes and those that
    distinct pages share, and on how many of the host's pages it is."""
    sizes = pages.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("size"), F.count("*").alias("host_pages"))
    hosts = durable(sizes.select("host", F.xxhash64("host").alias("hash"), "size", "host_pages", F.ceil(2 * F.col("size") / host_bytes).cast("long").alias("buckets")), "hosts")
    large = hosts.where(F.col("size") > host_bytes).select("host", "hash", "buckets")
    kind = "host long, region string, suffixes long, repeats long, pages long"
    whole = _region_rows(pages.join(large, "host", "left_anti")).groupBy("host").applyInArrow(lambda t: _counts(t, run), kind)
    parts = _region_rows(pages.join(large, "host", "left_semi")).join(large.select(F.col("hash").alias("host"), "buckets"), "host")
    hot = _dealt(parts, run).groupBy("host", "region", "bucket").applyInArrow(_bucket_counts, kind)
    found = whole.union(hot).groupBy("host", "region").agg(*[F.sum(c).alias(c) for c in ("suffixes", "repeats", "pages")])
    return found.join(hosts.select(F.col("hash").alias("host"), "host_pages"), "host")


def decide(found: DataFrame) -> DataFrame:
    """host, kept, dropped: the regions of each host that repeats decide, from (host, region, suffixes, repeats, pages,
    host_pages); others are ties."""
    found = durable(found, "repeats")
    share, unique = F.col("repeats") / F.greatest("suffixes", F.lit(1)), F.col("suffixes") - F.col("repeats")
    main = lambda df, *by: df.groupBy(*by).agg(F.max_by("region", F.struct(unique, "region")).alias("main"), F.max_by(share, F.struct(unique, "region")).alias("base"))

    def verdict(enough: int) -> Column:
        tells = F.col("suffixes") >= enough
        boilerplate = (F.col("repeats") >= FEWEST) & (share >= F.greatest(F.lit(LEAST), F.lit(TIMES) * F.col("base")))
        return F.when(tells & (F.col("region") == F.col("main")), 1).when(tells & boilerplate, -1).when(tells & (F.col("suffixes") >= MANY) & (share < HARDLY), 1)

    own = found.join(main(found, "host"), "host").where(F.col("pages") * COMMON >= F.col("host_pages")).select("host", "region", verdict(ENOUGH).alias("own"))
    pooled = found.groupBy("region").agg(F.sum("suffixes").alias("suffixes"), F.sum("repeats").alias("repeats"))
    top = main(pooled).select("main", "base").first()  # one row
    pooled = pooled.select("*", F.lit(top["main"]).alias("main"), F.lit(top["base"]).alias("base")).select("region", verdict(ENOUGH).alias("pooled"))
    both = own.join(pooled, "region").select("host", "region", F.coalesce("own", "pooled").alias("verdict")).where("verdict IS NOT NULL")
    return both.groupBy("host").agg(F.collect_set(F.when(F.col("verdict") == 1, F.col("region"))).alias("kept"), F.collect_set(F.when(F.col("verdict") == -1, F.col("region"))).alias("dropped"))


def main_text(html: str, kept: set[str], dropped: set[str]) -> tuple[str, int, int]:
    """(text, blocks that repeats decided, blocks) of a page."""
    found, kinds = blocks(html)
    has_main = any(r not in dropped and (r in kept or kinds[r] == 1) for r, _ in found)
    by_name = lambda r: kinds[r] == 1 or (kinds[r] == 0 and not has_main)
    return "\n".join(t for r, t in found if r in kept or (r not in dropped and by_name(r))), sum(r in kept or r in dropped for r, _ in found), len(found)


def extract_pages(pages: DataFrame, run: int = RUN, host_bytes: int = HOST_BYTES) -> DataFrame:
    """page_id, url, text, n_decided (blocks that repeats decided), n_blocks for each row of pages (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    decided = durable(decide(repeats(rows.select("host", "html"), run, host_bytes)), "regions")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 2, CHUNK)):
            out = [main_text(h or "", set(k or ()), set(d or ())) for h, k, d in zip(*(batch[c].to_pylist() for c in ("html", "kept", "dropped")), strict=True)]
            text, n, m = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["page_id", "url", "text", "n_decided", "n_blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    named = rows.withColumn("host", F.xxhash64("host")).join(decided, "host", "left")
    return named.select("page_id", "url", "html", "kept", "dropped").mapInArrow(extract, f"page_id {kind}, url string, text string, n_decided long, n_blocks long")


def text_digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_decided", "n_blocks")
