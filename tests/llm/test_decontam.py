import random

from helpers import clash, docs
from pyspark.sql import functions as F

from tidemark.llm import decontam
from tidemark.llm.queries import QUERIES

ITEM = "A train leaves Boston at 60 km per hour and reaches the coast after 3 hours, how far is the coast from Boston in miles today"
WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "seven", "under"]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n)) + "."


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def leaks(spark, texts, items, **more):
    found = decontam.find_leaks(docs(spark, list(texts)), bench(spark, items), **more).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_templates():
    words, kind, hashes = decontam.template("Then Anna paid $5.50 for 3 kg, not 4kg. The price of Bread rose 10% | again")
    marks = dict(zip(words, kind.tolist()))
    assert marks["anna"] == marks["bread"] == decontam.NAME
    assert marks["$5.50"] == marks["3"] == marks["4kg"] == marks["10%"] == decontam.NUMBER
    assert marks["kg"] == decontam.UNIT
    assert marks["the"] == marks["then"] == decontam.PLAIN
    assert "" not in words and len(words) == len(hashes)
    assert decontam.template(None)[0] == decontam.template("  \n. !")[0] == []


def test_verbatim_reworded_and_contradictory(spark):
    r = random.Random(1)
    reworded = ITEM.replace("60", "85").replace("3 hours", "5 hours").replace("Boston", "Denver").replace("km", "miles")
    contradictory = ITEM.replace("Boston at", "Denver at")  # the other mention still says Boston
    texts = {
        1: f"{prose(r, 30)} {ITEM} {prose(r, 30)}", 2: f"{prose(r, 30)} {reworded}. {prose(r, 5)}", 3: f"{prose(r, 9)} {contradictory}", 4: prose(r, 500), 5: ITEM.upper().lower(),
    }
    found = leaks(spark, texts.items(), [(7, ITEM)])
    assert found[1, 7].kind == "verbatim" and found[1, 7].coverage > 0.9
    assert found[2, 7].kind == "reworded"
    assert (3, 7) not in found and (4, 7) not in found


def test_two_rewordings_in_one_text_both_count(spark):
    a, b = ITEM.replace("60", "70"), ITEM.replace("60", "90")
    found = leaks(spark, [(1, f"first. {a}. second. {b}.")], [(7, ITEM)])
    assert found[1, 7].kind == "reworded"


def test_matches_plain_windows_on_random_texts(spark):
    """Without slots a leak is a share of the item's words in shared eight-word windows."""
    r = random.Random(2)
    items = [(i, " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(r.randint(8, 30)))) for i in range(12)]
    texts = []
    for d in range(60):
        words = prose(r, r.randint(0, 20)).split()
        for _ in range(r.randint(0, 2)):
            item = r.choice(items)[1].split()
            a = r.randint(0, len(item) - 1)
            words += item[a: a + r.randint(1, len(item))]
        texts.append((d, " ".join(words)))
    want = {}
    for d, text in texts:
        w = text.replace(".", "").split()
        grams = {tuple(w[i: i + 8]) for i in range(len(w) - 7)}
        for i, item in items:
            v = item.split()
            covered = {k for j in range(len(v) - 7) if tuple(v[j: j + 8]) in grams for k in range(j, j + 8)}
            if len(covered) / len(v) >= 0.5:
                want[d, i] = len(covered) / len(v)
    found = leaks(spark, texts, items)
    assert {k: x.coverage for k, x in found.items()} == want and want


def test_long_runs_of_long_items_count(spark):
    r = random.Random(4)
    item = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [(1, " ".join(item[90:230])), (2, " ".join(item[40:60])), (3, " ".join(item[40:59])), (4, " ".join(item[0:12] + ["x"] + item[12:24] + ["x", "y"] + item[24:36]))]
    found = leaks(spark, [(i, f"{prose(r, 20)} {t} {prose(r, 20)}") for i, t in texts], [(7, " ".join(item))])
    assert set(found) == {(1, 7), (2, 7)}
    assert round(found[1, 7].coverage * 300) == 140 and found[2, 7].kind == "verbatim"


def test_words_match_in_any_case_and_place(spark):
    short, numbers = "What is the capital of France", "Add 3 7 12 19 28 and 41 then 60 85 and 90"
    named = "Then Anna met Bert near Paris and Carl saw Dora in Rome while Emil and Fritz left London for Oslo with Gina"
    items = [(1, short), (2, numbers), (3, named), (4, "Bread costs 3 dollars in the town here")]
    texts = {
        1: f"Question 3\n{short}?", 2: f"Question 3\n{numbers}.", 3: named.lower(), 4: named.upper(), 5: "so " + short.lower(),
        6: "Question 4\nBread costs 8 dollars in the town here",
    }
    found = leaks(spark, texts.items(), items)
    assert set(found) == {(1, 1), (5, 1), (2, 2), (3, 3), (4, 3), (6, 4)}
    assert found[3, 3].kind == found[2, 2].kind == found[1, 1].kind == "verbatim" and found[6, 4].kind == "reworded"
    assert found[6, 4].coverage == 1


def plain_windows(text, least=4, item=False):
    """Windows by the rules, with words instead of hashes: (width, place, form, words or template, slots)."""
    marks = {decontam.NUMBER: "<n>", decontam.NAME: "<N>", decontam.UNIT: "<u>"}
    words, kind, _ = decontam.template(text)
    widths = [min(8, len(words))] if item else range(least, 9)
    out = []
    for width in widths:
        if width < least:
            continue
        for at in range(len(words) - width + 1):
            own, kinds = words[at: at + width], kind[at: at + width].tolist()
            versions = [kinds]
            if item and at == 0 and kinds[0] == 0 and decontam._hashed(text)[3]:
                versions.append([decontam.NAME, *kinds[1:]])
            plain = kinds.count(0)
            out.append((width, at, "words" if plain < width else "both", tuple(own), kinds))
            for ks in versions:
                if min(least, width) <= ks.count(0) < width:
                    out.append((width, at, "template", tuple(marks.get(k, w) for w, k in zip(own, ks)), ks))
    return words, out


def plain_leaks(texts, items):
    """Leaks by the rules: windows equal by words or by template, copies by their shift, consistent slots, half of the item or 20 words in a row."""
    found = set()
    for i, item in items:
        item_words, of_item = plain_windows(item, item=True)
        for d, text in texts:
            words, of_doc = plain_windows(text)
            copies = {}
            for w, at, form, mark, _ in of_doc:
                for v, place, other, theirs, kinds in of_item:
                    typed = form == "template"
                    if w != v or mark != theirs or typed != (other == "template"):
                        continue
                    slots = {(k, item_words[place + j], (words[at + j] if typed else item_words[place + j])) for j, k in enumerate(kinds) if k}
                    for rule in (0, 1) if form == other and form != "words" else (1,):
                        c = copies.setdefault((rule, at - place), (set(), set(), w))
                        c[0].add(place)
                        c[1].update(slots)
            by_rule = {}
            for (rule, _), (places, slots, w) in copies.items():
                if all(a == b for _, a, b in slots) or len({(k, a) for k, a, _ in slots}) == len(slots):
                    covered = {p + j for p in places for j in range(w)}
                    run = best = 0
                    for p in range(len(item_words)):
                        run = run + 1 if p in covered else 0
                        best = max(best, run)
                    total, longest = by_rule.get(rule, (set(), 0))
                    by_rule[rule] = (total | covered, max(longest, best))
            if any(len(c) / len(item_words) >= 0.5 or run >= 20 for c, run in by_rule.values()):
                found.add((d, i))
    return found


def test_all_rules_against_brute_force(spark):
    """Literal windows, names, numbers and units, other case, short items, long runs, in random copies with changes."""
    r = random.Random(11)
    pool = WORDS + ["Anna", "Bert", "Paris", "3", "7", "12.5", "km", "kg", "$4", "10%", "4kg", "Then", "hours"]
    items = [(i, " ".join(r.choices(pool, k=r.choice([2, 4, 5, 7, 8, 9, 14, 60])))) for i in range(25)]
    texts = []
    for d in range(150):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(items)[1].split()
            a = r.randint(0, max(len(words) - 4, 0)) if r.random() < 0.5 else 0
            words = words[a: a + r.randint(3, 40)]
            for k, w in enumerate(words):
                if r.random() < 0.15:
                    words[k] = r.choice(pool)
                elif r.random() < 0.1:
                    words[k] = w + r.choice([".", ",", "?", " ."])
            part = " ".join(words)
            parts.append(r.choice([part, part, part.lower(), part.upper()]))
        texts.append((d, r.choice([" ", ". ", "\n", " x "]).join(parts)))
    want = plain_leaks(texts, items)
    assert set(leaks(spark, texts, items)) == want and len(want) > 40


def test_short_items_nulls_ties_and_empty_tables(spark):
    items = [(1, "alpha stone river cloud green"), (2, "alpha beta"), (3, None), (4, ""), (5, "alpha stone river cloud green")]
    texts = [(1, "x alpha stone river cloud green y"), (1, "x alpha stone river cloud green y"), (2, None), (3, ""), (None, "alpha stone river cloud green"), (4, "alpha beta")]
    found = decontam.find_leaks(clash(docs(spark, texts)), clash(bench(spark, items))).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("1", 1), ("1", 5), ("None", 1), ("None", 5)]
    table = docs(spark, texts)
    assert decontam.find_leaks(table.where("false"), bench(spark, items)).count() == 0
    assert decontam.find_leaks(table, bench(spark, [])).count() == 0
    kept = decontam.remove_leaks(clash(table), decontam.find_leaks(table, bench(spark, items)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4"]


def test_long_text_and_hot_item(spark):
    r = random.Random(3)
    found = leaks(spark, [(1, prose(r, 60_000) + " " + ITEM), (2, (ITEM + ". ") * 500)], [(7, ITEM)])
    assert set(found) == {(1, 7), (2, 7)}


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, path).collect()}
    items = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    want = spark.read.parquet(f"{path}/documents.parquet").join(items, F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    assert found == {(r.doc_id, r.item_id) for r in want.collect()}
