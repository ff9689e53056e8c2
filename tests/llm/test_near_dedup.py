import random
import re

from stagelens.llm.near_dedup import near_duplicates, one_of_each
from stagelens.llm.graphs import components

SCHEMA = "doc_id long, text string, lang string, digest string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    name = {d: d for d, _ in sets if d is not None}

    def find(d):
        while name[d] != d:
            d = name[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def check(spark, rows, percent=85):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def corpus(seed=1):
    """Families of copies with few and many edits, with and without the text they come from."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, k = [], 0
    for family in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 150]))]
        for copy in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 6]) if copy or family % 2 else 0):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                del text[-rng.randrange(1, 8) :]
            rows.append((k * 7 % 1000 + k, " ".join(text), "en", "x"))
            k += 1
    rng.shuffle(rows)
    return rows


def test_families_against_brute_force(spark):
    check(spark, corpus())


def test_families_at_a_lower_level(spark):
    check(spark, corpus(4), 80)


def test_several_texts_of_one_id(spark):
    rng = random.Random(9)
    text = [" ".join(str(rng.randrange(1000)) for _ in range(60)) for _ in range(3)]
    rows = [(5, text[0], "", ""), (5, text[1], "", ""), (5, text[2], "", ""), (7, text[1] + " more", "", ""), (8, text[2], "", ""), (9, text[0] + " more", "", "")]
    got = {tuple(sorted(map(tuple, near_duplicates(spark.createDataFrame(x, SCHEMA).repartition(n)).collect()))) for x in (rows, rows[::-1]) for n in (1, 3)}
    assert len(got) == 1


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (2, "", "en", ""), (3, " \t\n\x0b\x0c\r ", "en", ""), (4, "one two", "en", ""), (5, "ONE  Two", "fr", ""), (6, "É two", "en", ""), (7, "é two", "en", ""), (None, "one two", None, None),
        (8, "a b c d e", "en", ""), (8, "a b c d e", "en", ""), (9, "a b c d e f", "en", ""), (10, "w " * 3000, "en", ""), (11, "w w w w w", "en", ""), (12, "x y z", "en", ""),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f g", "en", "p"), (2, "A b c d e f g", "fr", "q"), (3, None, None, None), (4, None, None, None)]
    df = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "text", "lang", "digest"] and sorted(r.doc_id for r in df.collect()) == [1, 3, 4]


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 1000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[1000 + i] == 5 for i in range(50))
