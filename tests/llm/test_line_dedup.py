import random
import re
from collections import defaultdict

from stagelens.llm.line_dedup import deduplicated

LONG = " ".join(f"word{i}" for i in range(50))
SCHEMA = "doc_id long, text string, removed string"
NAMES = ["doc_id", "n_units", "n_removed", "removed", "text", "words_removed", "longest_removed"]


def run(spark, rows, parts=2):
    got = deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=str)


def units(text):
    """Begin, end and normalised form of each unit, word by word."""
    out, at = [], 0
    for line in text.split("\n"):
        words = [m.span() for m in re.finditer(r"[^\t\x0b\x0c\r ]+", line)]
        begin = 0
        for k, (_, end) in enumerate(words):
            if k + 1 == len(words) or k - begin >= 4 and line[end - 1] in ".!?":
                a, b = words[begin][0], end
                out.append((at + a, at + b, " ".join(line[x:y] for x, y in words[begin : k + 1]).lower()))
                begin = k + 1
        at += len(line) + 1
    return out


def brute(rows):
    """Ids must be different."""
    seen, out = set(), []
    for doc, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = units(text or "")
        gone = [i for i, u in enumerate(found) if u[2] in seen or any(u[2] == v[2] for v in found[:i])]
        seen |= {u[2] for u in found}
        left, at = [], 0
        for line in (text or "").split("\n"):
            own = [(i, u) for i, u in enumerate(found) if at <= u[0] <= at + len(line) and line]
            kept = [text[u[0] : u[1]] for i, u in own if i not in gone]
            if len(kept) == len(own):
                left.append(line)
            elif kept:
                left.append(" ".join(kept))
            at += len(line) + 1
        runs = defaultdict(int)
        for k, i in enumerate(gone):
            runs[i - k] += len(found[i][2].split(" "))
        removed = ",".join(f"{found[i][0]}:{found[i][1]}" for i in gone)
        out.append((doc, len(found), len(gone), removed, None if text is None else "\n".join(left), sum(runs.values()), max(runs.values(), default=0)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    sentences = [" ".join(rng.choice(["The", "cat", "sat", "on", "É", "mat", "x"]) for _ in range(rng.choice([1, 2, 4, 5, 6, 9]))) + rng.choice([".", "!", "?", "..", "", ","]) for _ in range(60)]
    text = lambda: "\n".join(rng.choice([" ", "  ", "\t"]).join(rng.choice(sentences) for _ in range(rng.choice([0, 1, 2, 5]))) for _ in range(rng.choice([1, 3, 6])))
    rows = [(k * 37 % 101, text(), "x") for k in range(100)]
    assert run(spark, rows) == brute(rows)


def test_a_passage_inside_a_line(spark):
    """A passage of over 50 words in the middle of two different lines goes from the later document, but for the part
    of its first sentence that stands in a sentence of the document's own."""
    passage = "Begin of it here. " + " ".join(f"Sentence {'abcdefghijklmnop'[i]} has a few more words." for i in range(10)) + " Last one is this sentence."
    rows = [(2, f"Own beginning of the second document {passage} Its own end comes here.", ""), (1, f"Another start entirely. {passage}\nMore.", "")]
    got = run(spark, rows)
    assert got == brute(rows) and got[0][2] == 0 and got[1][6] >= 60
    assert got[1][4] == "Own beginning of the second document Begin of it here. Its own end comes here."


def test_short_sentences_go_with_the_next(spark):
    rows = [(1, "Yes. No. Well, this is the first of them.", ""), (2, "Yes. No. And that is the second one.", ""), (3, "Hello.\nYes. No. Well, this is the first of them.", ""), (4, "Hello.\nOwn.", "")]
    assert [(r[2], r[4]) for r in run(spark, rows)] == [(0, rows[0][1]), (0, rows[1][1]), (1, "Hello."), (1, "Own.")]


def test_repeats_in_one_document(spark):
    assert run(spark, [(1, f"{LONG}\n{LONG.upper()}", "")])[0][2:] == (1, f"{len(LONG) + 1}:{2 * len(LONG) + 1}", LONG, 50, 50)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, LONG, None), (3, LONG, ""), (3, LONG, ""), (4, "\n \n", "")]
    got = run(spark, rows)
    assert [r[2] for r in got] == [0] * 6 and [r[4] for r in got] == [None, "", LONG, LONG, "\n \n", LONG]
    assert run(spark, []) == []


def test_very_long_text_and_a_very_common_line(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(0, long, ""), (1, f"{long}\nThe common line.", "")] + [(k, f"The common line.\nOwn line {k}.", "") for k in range(2, 400)]
    got = run(spark, rows, 5)
    assert got == brute(rows) and sum(r[2] for r in got) == 1 + 398


def test_different_texts_of_one_id(spark):
    rows = [(1, LONG, ""), (2, f"{'x' * len(LONG)}\nmine", ""), (2, f"{LONG}\nmine", "")]
    got = run(spark, rows)
    assert sorted(r[4] for r in got) == sorted([LONG, f"{'x' * len(LONG)}\nmine", "mine"]) or sorted(r[4] for r in got) == sorted([LONG, "x" * len(LONG), "mine"])
    assert got == run(spark, rows[::-1], 3)
