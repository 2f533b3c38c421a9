import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import actions, clean, components, decisions, ingest, names, quality_gate, suppliers, velocity
from shelfspark.sources import files


def key(s):
    return "".join(c for c in s.lower() if c.isalnum() and c.isascii())


def brute_match(name, inventory):
    """The fallback chain as plain loops."""
    inv = {key(i) for i in inventory} - {""}
    head = name.split("<-")[0].strip()
    for k in dict.fromkeys((key(name), key(head))):
        if not k:
            continue
        if k in inv:
            return k
        starts = [i for i in inv if len(i) >= 10 and k.startswith(i)]
        if starts and len(k) >= 10:
            return max(starts, key=len)
        cut = [i for i in inv if len(i) >= 10 and len(k) >= 10 and i.startswith(k)]
        if cut:
            return cut[0] if len(cut) == 1 else None
    return key(head)


def test_names_match_like_the_loops(spark):
    rng = random.Random(3)
    stems = ["full cream milk", "frozen peas", "edam cheese block", "butter"]
    inventory = [f"{rng.choice(stems)} {rng.randint(1, 40)}" for _ in range(60)] + [f"{s} 1 large" for s in stems]
    sold = [rng.choice(inventory) for _ in range(40)] + [i[:-1] for i in inventory] + [i + " extra" for i in inventory[:20]] + [i + " <- out" for i in inventory[:20]] + ["nothing alike", "x"]
    got = names.match_names(spark.createDataFrame([(1, s) for s in sold], "session_id long, name string"), spark.createDataFrame([(1, i) for i in inventory], "session_id long, item string"))
    for r in got.collect():
        assert r.key == brute_match(r.name, inventory), r.name


@pytest.mark.parametrize(
    ("months", "pattern", "corrected"),
    [([100] * 11 + [10000], "spiky", 100), ([100] * 11 + [1300], "spiky", 100), ([100] * 12, "stable", None), ([100] * 9 + [20] * 3, "volatile", None), ([100] * 11 + [0], "volatile", None), ([0] * 10 + [100, 200], "lumpy", None), ([100, 200, 9000], "stable", None), ([0] * 4, "stable", None)],
)
def test_demand_shapes(spark, months, pattern, corrected):
    df = spark.createDataFrame([(1, "a", m, float(q)) for m, q in enumerate(months)], "session_id int, key string, month int, qty double")
    r = velocity.demand_shapes(df).first()
    assert (r.pattern, r.corrected) == (pattern, corrected)


STATUS = [(2.0, 3.7, 100, 500, "CRITICAL"), (3.7, 3.7, 100, 500, "LOW"), (5.7, 3.7, 100, 500, "LOW"), (5.8, 3.7, 100, 500, "HEALTHY"), (0.9, None, 100, 500, "CRITICAL"), (1.0, None, 100, 500, "LOW"), (3.0, None, 100, 500, "LOW"), (3.1, None, 100, 500, "HEALTHY"), (None, None, 0, None, "DEAD"), (None, None, 5, None, "HEALTHY"), (None, None, None, 3, "LOW"), (None, None, None, None, "HEALTHY"), (None, None, 0, 9, "CRITICAL"), (None, None, 40, 0, "DEAD")]


def test_status_rules(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(STATUS)], "i int, ms double, lt double, stock int, sold int, want string")
    rows = df.withColumn("got", decisions.final_status(*[F.col(c) for c in ("ms", "lt", "stock", "sold")])).collect()
    assert all(r.got == r.want for r in rows), [r for r in rows if r.got != r.want]


def test_reorder_of_the_planted_item(spark):
    r = spark.range(1).select(decisions.suggested_quantity(F.lit(300.0), F.lit(112), F.lit(0.2)).alias("q")).first()
    assert r.q == 1570


def test_split_rows_merge_by_unit(spark):
    rows = [(1, 1, "Anchor", "", "CTN", 100.0, "o"), (1, 2, "anchor!", "", "", 150.0, "o"), (1, 3, "ANCHOR", "", "KG", 7.0, "o"), (1, 4, "", "", "", 1.0, "o"), (1, 5, "", "", "", 2.0, "o")]
    df = spark.createDataFrame(rows, "session_id int, row_no int, item string, category string, uom_raw string, stock double, org_name string")
    got = sorted((r.row_no, r.uom, r.stock) for r in clean.merge_split_rows(df).collect())
    assert got == [(1, "CTN", 250.0), (3, "KG", 7.0), (4, "", 1.0), (5, "", 2.0)]


def test_fuzzy_pairs_keep_what_the_ratio_says(spark):
    from difflib import SequenceMatcher

    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 12))) for _ in range(25)]
    all_names = sorted({*base, *(b[:-1] + "z" for b in base), *(b + "q" for b in base)})
    want = {(a, b) for a in all_names for b in all_names if a < b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    got = suppliers.fuzzy_pairs(spark.createDataFrame([("o", n) for n in all_names], "org_name string, supplier string")).collect()
    assert {(r.a, r.b) for r in got} == want


def test_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(0, 30) if i % 10 != 9]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["n9"] == "n0" and got["n19"] == "n10" and len(set(got.values())) == 4 - 1


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds, write = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, name: rounds.append(name) or write(df, name))
    rng, names_ = random.Random(8), [f"n{i:04d}" for i in range(3000)]
    rng.shuffle(names_)
    got = components.components(spark.createDataFrame(list(zip(names_, names_[1:], strict=False)), "a string, b string"))
    assert [tuple(r) for r in got.groupBy("component").count().collect()] == [("n0000", 3000)]
    assert rounds.count("step") < 20


def test_prefixes_of_nested_keys_equal_the_loops(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    keys = list({word(rng.randint(1, 7)) for _ in range(150)})
    texts = list({word(rng.randint(1, 9)) for _ in range(300)} - set(keys))
    rows = lambda x: spark.createDataFrame([(s, v) for s in (1, 2) for v in x[s - 1 :: 2]], "session_id long, v string")
    got = names.prefixes(rows(keys).withColumnRenamed("v", "k"), rows(texts).withColumnRenamed("v", "t")).collect()
    assert len(got) == len(texts)
    for r in got:
        own = keys[r.session_id - 1 :: 2]
        starts, whole = [k for k in own if r.t.startswith(k)], [k for k in own if k.startswith(r.t)]
        assert r.longest == max(starts, key=len, default=None) and r.n_whole == len(whole) and r.whole == (whole[0] if len(whole) == 1 else None), r


def test_gate_blocks_hide_warnings(spark):
    inv = spark.createDataFrame([(1, "words", "CTN"), (2, "1.200,50", "CTN"), (3, "", "CTN")], "session_id int, stock_raw string, uom_raw string")
    sales = spark.createDataFrame([(2, "12,5", "KG"), (1, "12,5", "KG")], "session_id int, qty_raw string, uom_raw string")
    overlap = spark.createDataFrame([(2, 10, 1)], "session_id int, names int, matched int")
    got = sorted((r.session_id, r.level, r.code) for r in quality_gate.findings(spark.createDataFrame([(1,), (2,), (3,), (4,)], "session_id int"), inv, sales, overlap).collect())
    assert got == [(1, "BLOCK", "stock_not_numeric"), (2, "WARN", "low_name_overlap"), (2, "WARN", "number_format"), (2, "WARN", "unit_mismatch"), (3, "BLOCK", "stock_blank"), (4, "BLOCK", "empty_file")]


def test_latest_action_wins(spark):
    log = spark.createDataFrame([(1, "approve", None, 1, 1), (1, "dismiss", None, 2, 2), (1, "edit", 5.0, 1, 3), (1, "edit", 0.0, 3, 4), (2, "edit", -1.0, 1, 5), (2, "order_placed", None, 1, 6), (2, "outcome", 1.0, 2, 7)], "item int, action string, value double, ts int, event_id int")
    got = {r.item: r for r in actions.rec_state(log, ["item"]).collect()}
    assert got[1].dismissed and not got[1].approved and got[1].edited_quantity is None
    assert got[2].order_placed and got[2].outcome == "avoided" and got[2].edited_quantity is None


def test_files_become_cells_and_headers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_bytes("﻿Sales report;;\n;;\nItem Description;Qty Sold;Date\nMilk;1;x\n".encode())
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Item</t></si><si><r><t>Full </t></r><r><t>milk</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>Qty</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>46188</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    csv = files.read_cells(spark, f"{tmp_path}/*.csv", "csv")
    assert ingest.header_rows(csv, "sales", 1).first().header_row == 2  # blank rows do not count
    assert [r.name for r in ingest.column_names(csv, ingest.header_rows(csv, "sales", 1)).orderBy("col_no").collect()] == ["item_description", "qty_sold", "date"]
    cells = [(r.row_no, r.col_no, r.value) for r in files.read_cells(spark, f"{tmp_path}/*.xlsx", "xlsx").orderBy("row_no", "col_no").collect()]
    assert cells == [(1, 1, "Item"), (1, 28, "Qty"), (2, 1, "Full milk"), (2, 28, "46188")]


def test_fuzzy_pairs_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    letters = "abcdefgh"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 5, 8, 11, 14, 16, 18, 25]))) for _ in range(60)]

    def bent(s):
        s = list(s)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s)) if s else 0
            rng.choice([lambda: s.insert(at, rng.choice(letters)), lambda: s and s.pop(at), lambda: s and s.__setitem__(at, rng.choice(letters))])()
        return "".join(s)

    names_ = [(o, x) for o in ("A", "B") for x in base + [bent(x) for x in base] + [bent(x) for x in base]]
    got = {(r.org_name, r.a, r.b): r.ratio for r in suppliers.fuzzy_pairs(spark.createDataFrame(names_, "org_name string, supplier string")).collect()}
    want = {}
    for org in "AB":
        keys = sorted({x for o, x in names_ if o == org and x})
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if (ratio := SequenceMatcher(None, a, b).ratio()) >= suppliers.FUZZY:
                    want[org, a, b] = ratio
    assert got == want and len(want) > 60


@pytest.mark.parametrize(("stated", "spiky", "total", "months", "want"), [(7.0, 3.0, 100.0, 10, 7.0), (0.0, 3.0, 100.0, 10, 3.0), (None, None, 100.0, 10, 10.0), (None, None, -5.0, 10, 0.0), (None, None, None, 10, 0.0)])
def test_average_that_orders_are_sized_on(spark, stated, spiky, total, months, want):
    df = spark.createDataFrame([(stated, spiky, total, months)], "stated double, spiky double, total double, months int")
    assert df.select(velocity.avg_monthly(*[F.col(c) for c in df.columns])).first()[0] == want


def test_a_cut_name_is_not_the_name_of_equal_letters(spark):
    inventory = ["blue gizmo Brand#20 330055", "blue gizmo Brand#2 033005", "red gizmo Brand#20 330055", "red gizmo Brand#20 330050", "red gizmo Brand#2 033005", "old gizmo Brand#2 033005"]
    sold = {"blue gizmo Brand#20 33005": "bluegizmobrand20330055", "red gizmo Brand#20 33005": None, "blue gizmo Brand#2 033005": "bluegizmobrand2033005", "old gizmo Brand#20 33005": "oldgizmobrand2033005", "BLUE GIZMO brand 2/033005 <- out": "bluegizmobrand2033005"}
    rows = lambda x, c: spark.createDataFrame([(1, v) for v in x], f"session_id long, {c} string")
    assert {r.name: r.key for r in names.match_names(rows(sold, "name"), rows(inventory, "item")).collect()} == sold


def test_fuzzy_pairs_of_many_blocks_and_organisations(spark):
    """Blocks of few keys hold several organisations and lengths; keys over 64 letters, repeated letters, digits."""
    from difflib import SequenceMatcher

    rng = random.Random(9)
    base = ["".join(rng.choice("ab1z") for _ in range(rng.choice([1, 2, 4, 7, 12, 20, 64, 70, 90]))) for _ in range(50)]
    names_ = sorted({(o, x) for o in ("A", "B", "C") for b in base if rng.random() < 0.8 for x in (b, b[:-1] + "1", b + "a", b[1:] + b[:1]) if x})
    got = {(r.org_name, r.a, r.b): r.ratio for r in suppliers.fuzzy_pairs(spark.createDataFrame(names_, "org_name string, supplier string"), block=7).collect()}
    want = {(o, a, b): ratio for o, a in names_ for p, b in names_ if o == p and a < b and (ratio := SequenceMatcher(None, a, b).ratio()) >= suppliers.FUZZY}
    assert got == want and len(want) > 100


def test_fuzzy_pairs_ask_little_of_all_pairs(spark):
    """No row is made for a pair before it has enough letters in common in one order."""
    rng = random.Random(3)
    keys = ["acme" + "".join(rng.choice("abcdefghijklmnop") for _ in range(14)) + "trading" for _ in range(600)]
    i, j = suppliers._common_letters(keys, ["o"] * 600, keys, ["o"] * 600, suppliers.FUZZY)
    x, _ = suppliers._common_in_order(keys, keys, i, j, suppliers.FUZZY)
    assert len(i) > 1500 and 600 <= len(x) < 700
    df = spark.createDataFrame([("o", k) for k in keys], "org_name string, supplier string")
    plan = suppliers.fuzzy_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_months_are_read_from_header_cells_only(spark):
    cells = spark.createDataFrame([(1, 1, 1, "Item"), (1, 1, 2, "Jan"), (1, 1, 3, "Feb-20"), (1, 2, 1, "Milk"), (1, 2, 2, "Mar")], "file long, row_no long, col_no int, value string")
    found = ingest.month_columns(cells, ingest.header_rows(cells, "sales", 3))
    assert sorted((r.col_no, r.month) for r in found.collect()) == [(2, 1), (3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "regexp_extract" in line]


def test_header_behind_the_first_rows(spark):
    """A file without a header in its first ten rows, one whose eleventh row would score more, an item row of a total."""
    note = [(1, r, 1, "note") for r in range(1, 13)] + [(1, 20, c, v) for c, v in ((1, "Item"), (2, "Jan"), (3, "Feb"))] + [(1, 21, 1, "Milk"), (1, 21, 3, "7"), (1, 22, 1, "TOTAL"), (1, 22, 2, "7")]
    other = [(2, 1, c, v) for c, v in ((1, "Item"), (2, "x"), (3, "y"))] + [(2, r, 1, "Peas") for r in range(2, 12)] + [(2, 12, c, v) for c, v in ((1, "Item"), (2, "Qty"), (3, "Price"))]
    cells = spark.createDataFrame(note + other, "file long, row_no long, col_no int, value string")
    heads = ingest.header_rows(cells, "sales", 3)
    assert {r.file: r.header_row for r in heads.collect()} == {1: 20, 2: 1}
    assert [tuple(r) for r in ingest.grid_rows(cells, heads).collect()] == [(1, 21, "Milk", 2, "7")]
