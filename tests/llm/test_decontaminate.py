import random
import re

from shelfspark.llm import decontaminate as d

BENCH = [(1, "A train leaves Boston at 40 km per hour and reaches Denver after 12 hours of steady travel along the river near Boston today"), (2, "five words are in here"), (3, None), (4, "too short item"), (None, "this item has no id but it has some words that can be found in a text")]


def leaks(spark, rows, bench=BENCH):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id): r for r in d.leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}


def test_exact_changed_and_clean(spark):
    rows = [
        (1, "Intro. " + BENCH[0][1] + " More text."),
        (2, "A train leaves Chicago at 70 km per hour and reaches Paris after 9 hours of steady travel along the river near Chicago today."),
        (3, "A train leaves Chicago at 70 km per hour and reaches Paris after 9 hours of steady travel along the river near Tokyo today."),
        (4, "xx\nFive, words are in here yy"), (5, "clean text of no interest at all to anyone who reads it for the first time today"), (6, "A TRAIN, leaves"),
    ]
    got = leaks(spark, rows)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed >= 4
    assert (got[2, 1].n_words, got[3, 1].n_words) == (24, 22)  # near Tokyo: Boston stands for two names


def test_short_item_inside_a_text(spark):
    assert (7, 2) in leaks(spark, [(7, "they said: five words are in here again")])


def test_items_of_few_words_are_found_verbatim(spark):
    rows = [(1, "A Too short, item!"), (2, "too short an item"), (3, "too short item")]
    assert set(leaks(spark, rows)) == {(1, 4), (3, 4)}
    assert set(leaks(spark, [(1, "it is so"), (2, "so it is"), (3, None)], [(9, "it is"), (8, "So")])) == {(1, 9), (1, 8), (2, 9), (2, 8)}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, BENCH[0][1]), (3, BENCH[0][1]), (3, BENCH[0][1]), (4, "word " * 100_000 + BENCH[0][1])]
    assert set(leaks(spark, rows)) == {(None, 1), (3, 1), (4, 1)}
    assert leaks(spark, []) == {} and leaks(spark, rows, [(1, None)]) == {}


def test_a_small_filter_gives_the_same(spark, monkeypatch):
    rows = [(1, BENCH[0][1]), (5, "some other text that has at least a few words in it and no item")]
    want = leaks(spark, rows)
    monkeypatch.setattr(d, "FILTER_BITS", 64)
    assert leaks(spark, rows) == want


def test_one_value_that_does_not_fit(spark):
    """39 words whose last slot alone disagrees; and two values of the item that share one of the document."""
    item = "Anna has 3 red balls and gives 5 of them to her friend Maria who lives in the old white house near the small river where Anna and Maria play every day until the sun goes down behind Anna"
    last = item[: -len("Anna")] + "Peter"
    merged = "so Eva has 3 red balls and gives 5 of them to Eva"
    got = leaks(spark, [(1, last), (2, merged)], [(1, item), (2, merged.replace("to Eva", "to Maria"))])
    assert (got[1, 1].n_words, got[1, 1].item_words) == (38, 39)
    assert (2, 2) not in got


def brute_force(docs, items):
    def typed(text):
        out, last = [], None
        for m in re.finditer(r"[^ \t-\r]+", text or ""):
            kept = [i for i in range(m.start(), m.end()) if not (ord(text[i]) < 128 and not text[i].isalnum())]
            if kept:
                raw = "".join(text[i] for i in kept)
                word = raw.lower()
                opens = last is None or bool(re.search(r"[.!?\n]", text[last : kept[0]]))
                number = any(c in "0123456789" for c in word)
                unit = bool(out) and out[-1][0] == "<number>" and word in d.UNITS
                name = raw[0] != word[0] and not opens and not number and not unit and len(word.encode()) > 1
                out.append(("<number>" if number else "<unit>" if unit else "<name>" if name else word, word, number or unit or name))
                last = kept[0]
        return out

    found = set()
    sides = [(i, typed(t)) for i, t in docs]
    for item_id, item in ((i, typed(t)) for i, t in items):
        n = len(item)
        for doc_id, doc in sides:
            for shift in range(-n, len(doc)):
                for literal in (False, True):
                    k = min(n, d.RUN if literal else d.WINDOW)
                    if k < (1 if literal else d.SHORTEST):  # shorter items verbatim only
                        continue
                    field, covered = (1 if literal else 0), set()
                    for a in range(n - k + 1):
                        ours = doc[a + shift : a + shift + k] if a + shift >= 0 else []
                        theirs = item[a : a + k]
                        if [x[field] for x in ours] == [x[field] for x in theirs] and (literal or 2 * sum(not x[2] for x in theirs) >= k):
                            covered |= set(range(a, a + k))
                    need = min(d.RUN, n)
                    for a in sorted(covered):
                        if all(i in covered for i in range(a, a + need)):
                            slots = {(item[i][1], doc[i + shift][1]) for i in range(a, a + need) if item[i][2] and not literal}
                            if len({x for x, _ in slots}) == len(slots) == len({y for _, y in slots}):
                                found.add((doc_id, item_id))
    return found


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = "a of the to red car runs fast over hills with Anna Bob Rome Oslo 7 12 40 km kg hours . ! and then".split(" ")
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 7, 9, 12, 14, 25, 40]))) for i in range(25)]
    docs = []
    for i in range(120):
        x = items[rng.randrange(len(items))][1].split(" ")
        if i % 3:  # another name or number, now and then not everywhere
            old, new = rng.choice([("Anna", "Bob"), ("Rome", "Lima"), ("7", "93"), ("40", "12"), ("km", "kg")])
            x = [new if w == old and rng.random() < 0.8 else w for w in x]
        if i % 4 == 0:
            x[rng.randrange(len(x))] = rng.choice(words)
        docs.append((i, " ".join([text(rng.randrange(12)), *x, text(rng.randrange(12))])))
    want = brute_force(docs, items)
    assert set(leaks(spark, docs, items)) == want and 30 < len(want) < len(docs) * len(items) / 4


def test_all_planted_thirteen_grams_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = {}
    for r in bench.collect():
        w = r.text.split()
        for i in range(len(w) - 19):
            grams.setdefault(tuple(w[i : i + 20]), set()).add(r.item_id)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = r.text.split()
        want |= {(r.doc_id, i) for k in range(len(w) - 19) for i in grams.get(tuple(w[k : k + 20]), ())}
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    assert want and want <= got


def test_verbatim_words_in_another_setting(spark):
    bench = [(1, "What does Ada Lovelace write in London today"), (2, "The Nile is long. Paris is old. Rome is warm. Oslo is cold. Lima is grey. Bonn is calm now"), (3, "Tom Ann Bob Eve Sue")]
    one, two, three = (t for _, t in bench)
    rows = [(1, f"Question: {one}"), (2, f'so "{one}" he said'), (3, two.replace(".", "")), (4, two.upper()), (5, two.title()), (6, two.replace(" Oslo", "\nOslo").replace(" is", "\nis")), (7, f"x - {three}, y"), (8, "What does Ada Lovelace write in Paris"), (9, two[:40])]
    assert set(leaks(spark, rows, bench)) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 3)}
