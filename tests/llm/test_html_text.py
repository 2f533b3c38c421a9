import html as entities
import re

import numpy as np

from shelfspark.llm import html_text as h

PAGE = '<html><head><title>t</title><style>p{x}</style><script>var a="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>{}<footer>&copy; x</footer></body></html>'
SCHEMA = "page_id long, url string, html string"


def test_blocks():
    found, kinds = h.blocks('<div>a<b>b</b> c&amp;d&copy;<p>x<span>y</span> <span class="ad">z</span>w</p><div class="comments big">no</div><main><p>q\n r</p><header>h</header></main>tail')
    assert found == [("/div", "ab c&d©"), ("/div", "xy zw"), ("/div/main", "q r"), ("/div/main/header", "h"), ("/div", "tail")]
    assert kinds == {"/div": 0, "/div/main": 1, "/div/main/header": -1}
    found, kinds = h.blocks(PAGE.replace("{}", "<article><h1>T</h1><p><b>one<br><p>two&nbsp; 2</p><aside>s</aside><form>f</form></article>"))
    assert [t for r, t in found if kinds[r] == 1] == ["T", "one", "two 2"] and [t for r, t in found if kinds[r] < 0] == ["Menu", "Buy", "s", "© x"]
    assert h.blocks("") == ([], {}) and h.blocks("<p>a &am b &lt")[0] == [("", "a &am b <")]
    assert max(len(r) for r in h.blocks("<div class=abc>" * 3000 + "x")[1]) <= h.LONG


def test_suffix_array_equals_brute_force():
    rng = np.random.default_rng(5)
    for run in (1, 2, 3, 5, 8):
        streams = [rng.integers(0, 3, n) for n in (40, 1, 2, 60, 30, 2, 7, 4)]
        streams += [streams[0][5:25], streams[6], np.array([9, 9])]
        page = [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
        windows = [[tuple(s[i : i + run]) for i in range(max(1, len(s) - run + 1))] for s in streams]
        where: dict = {}
        for p, ws in zip(page, windows, strict=True):
            for w in ws:
                where.setdefault(w, set()).add(p)
        of = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        got = h.repeated(np.concatenate(streams), of, np.array(page)[of], run)
        for i, ws in enumerate(windows):
            want = [len(where[w]) > 1 for w in ws] + [False] * (len(streams[i]) - len(ws))
            assert got[of == i].tolist() == want, (run, i)
        token = np.concatenate(streams)
        order, lcp = h.suffix_order(token, np.cumsum([len(s) for s in streams])[of], run)
        cut = [tuple(token[a : min(a + run, e)]) for a, e in zip(range(len(token)), np.cumsum([len(s) for s in streams])[of].tolist(), strict=True)]
        assert [cut[i] for i in order] == sorted(cut) and all(cut[a][:n] == cut[b][:n] for a, b, n in zip(order[1:], order, lcp[1:], strict=False))


def _site(menus, n=60, own=lambda i: f"{i} " + " ".join(f"own{i}x{j}" for j in range(40)), shape="<body><div>{}</div><section>{}</section></body>"):
    return [(i, "http://h.example/a", shape.format(menus(i), own(i))) for i in range(n)]


def test_repeats_decide_pages_without_names(spark):
    menu = " ".join(f"menu{i}" for i in range(30))
    rows = _site(lambda i: menu) + [(99, "http://one.example/", f"<body><div>{menu}</div><section>own text</section></body>")]
    got = {r.page_id: r for r in h.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].text == rows[i][2].split("<section>")[1].split("</section>")[0] for i in range(60))
    assert got[99].text == "own text" and got[99].n_decided == 2  # what all hosts show decides a host of one page
    apart = _site(lambda i: " ".join(f"m{i}x{j}" for j in range(30)))  # nothing repeats: nothing is boilerplate
    assert all(r.text.startswith("m") for r in h.extract_pages(spark.createDataFrame(apart, SCHEMA)).collect())


def test_repeats_outweigh_names(spark):
    """A nav whose text no other page has is unique text; one that repeats goes; with too little text to tell, its name decides."""
    shape = "<body><nav>{}</nav><article>{}</article></body>"
    unique = lambda i: " ".join(f"m{i}x{j}" for j in range(40))
    for menus, n, kept in ((unique, 60, True), (lambda i: "one menu " * 20, 60, False), (unique, 3, False)):
        got = h.extract_pages(spark.createDataFrame(_site(menus, n, shape=shape), SCHEMA)).collect()
        assert all(("\n" in r.text) == kept and r.text.endswith("x39") for r in got)


def test_copies_and_reprints_repeat_nothing(spark):
    words = " ".join(f"own{i}" for i in range(300))
    rows = [(i, "http://c.example/", f"<body><section>{words}</section><div>menu {i}</div></body>") for i in range(40)]
    got = h.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text.startswith(words) for r in got)


def test_a_large_host_counts_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "http://big.example/", f"<body><div>{' '.join(map(str, rng.integers(0, 3, 12)))}</div><p>{' '.join(map(str, rng.integers(0, 4, n)))}</p></body>") for i, n in enumerate([40, 2, 0, 600, 30] * 8)]
    pages = spark.createDataFrame(rows + rows[:3], SCHEMA).select("html", h.host(h.F.col("url")).alias("host"))
    small, large = (sorted(map(tuple, h.repeats(pages, host_bytes=b).collect())) for b in (h.HOST_BYTES, 900))
    assert small == large and sum(r[3] for r in small) > 0


def test_no_word_of_a_line_is_lost():
    text = lambda page: "\n".join(h.main_text(page, set(), set())[0].split("\n"))
    page = "<body><nav>m</nav><article><p>Take <span class='alert'>two</span> pills <a class='share'>daily</a>.</p><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then<script>no()</script> so<button>no</button>.</p></article></body>"
    assert text(page) == "Take two pills daily.\nIf x=1 then so."
    assert text("<body><nav>m</nav><article class='post related'><p>all</p></article><div class='related'>r</div></body>") == "all"
    # a form that ends hides its text, one that never ends only its controls
    assert text("<body><article>a</article><form>f</form></body>") == "a"
    assert text("<body><form action=x><select><option>no</select><article><p>a</p></article></body></html>") == "a"
    assert text("<body><div><form>f<input></div><article>a</article></body>") == "a"
    assert text("<article><ul><li>a<li>b<table><tr><td>c<td>d<tr><td>e</table></ul><p>f<p>g</article>") == "a\nb\nc\nd\ne\nf\ng"


def test_stray_end_tags_take_linear_time():
    import time

    for page in ("<p>x" * 60_000 + "</div>" * 60_000, "<span>x" * 60_000 + "</b>" * 60_000, "<div>x" * 30_000 + "</b></i>" * 30_000 + "</div>" * 30_000):
        start = time.process_time()
        assert sum(len(t) for _, t in h.blocks(page)[0]) >= 30_000
        assert time.process_time() - start < 20


def test_a_class_for_each_page_makes_no_region_for_each(spark):
    own = lambda i: f"{i} " + " ".join(f"own{i}x{j}" for j in range(40))
    menu = " ".join(f"menu{i}" for i in range(30))
    shape = "<body><div>{}</div><section class='post-%d'>{}</section></body>"
    rows = [(i, "http://h.example/a", (shape % i).format(menu, own(i))) for i in range(60)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert all(r.text == own(r.page_id) for r in h.extract_pages(pages).collect())
    # names that differ in letters too stay out of what is kept of a host
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, "http://h.example/a", f"<body><div>{menu}</div><section class='{letters(i)}'>{own(i)}</section></body>") for i in range(300)]
    found = h.repeats(spark.createDataFrame(rows, SCHEMA).select("html", h.host(h.F.col("url")).alias("host")), host_bytes=900)
    assert {r.pages for r in found.collect()} == {1, 300} and {r.host_pages for r in found.collect()} == {300}
    decided = h.decide(found).first()
    assert len(decided.kept) + len(decided.dropped) <= 2 and "/body/div" in decided.dropped
    assert all(r.text == own(r.page_id) for r in h.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect())


def test_edge_cases(spark):
    rows = [(None, None, None), (1, "http://a.example/", ""), (1, "http://a.example/", ""), (2, "not a url", "<article>" + "<p>word</p>" * 50_000 + "</article>"), (3, "", "<article><p>same</p></article>"), (4, "", "<article><p>same</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, host string, text int")
    got = h.text_digest(pages).collect()
    assert len(got) == 6 and {(r.page_id, r.n_chars) for r in got} == {(None, 0), (1, 0), (2, 50_000 * 5 - 1), (3, 4), (4, 4)}
    assert h.text_digest(pages.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    for table in ("sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{table}/pages.parquet")
        got = {r.page_id: r for r in h.text_digest(pages).collect()}
        for r in pages.collect():
            article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
            parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>|<br>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article))
            assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert sum(r.n_decided for r in got.values()) >= 0.99 * sum(r.n_blocks for r in got.values())
