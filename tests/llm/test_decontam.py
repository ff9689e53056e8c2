import hashlib
import random
import re

from stagelens.llm import decontam as D

DOCS, BENCH = "doc_id long, text string, doc string, found string", "item_id long, text string, words string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    out = []
    for d, t, *_ in docs:
        w, hit, items = words(t), set(), set()
        for i, b, *_ in bench:
            v = words(b)
            n = min(13, len(v))
            for k in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        items |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, bench):
    got = D.hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, bench)


def test_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["the", "of", "a", "Éa", "x1", "naïve", "b", "c"]) for _ in range(n))
    bench = [(i, some(rng.choice([1, 3, 12, 13, 14, 30])), "x") for i in range(12)] + [(20, "the " * 40, "x"), (21, bench_text := some(20), "x"), (22, bench_text, "x")]
    docs = [(i, some(60) + " " + rng.choice(bench)[1] + ", " + some(rng.choice([0, 400])), "x", "y") for i in range(30)] + [(100, "The, the; " * 30, "x", "y")]
    check(spark, docs, bench)


def test_odd_rows(spark):
    docs = [(1, None, None, None), (2, "", "", ""), (3, "!!! --", "", ""), (None, "alpha beta gamma", None, None), (5, "alpha beta", "", ""), (5, "alpha BETA gamma", "", ""), (6, "alpha-beta", "", "")]
    check(spark, docs, [(1, "alpha beta", None), (None, "gamma", None), (3, None, None), (4, "...", None), (10, "beta", ""), (9, "beta", "")])
    check(spark, docs, [])
    check(spark, [], [(1, "a", "")])


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "x", "y"), (2, "nothing here", "x", "y"), (None, "none", None, None)], DOCS)
    got = D.clean(docs, spark.createDataFrame([(1, "alpha beta gamma", "x")], BENCH))
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "None"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "three two one"), (3, "one x x x x x two three"), (4, "one two")], "doc_id long, text string")
    phrases = D.windows(spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    index = D.postings(docs, phrases.selectExpr("explode(words) as term").distinct())
    assert sorted({r.doc for r in D.proximity(index, phrases, 4).collect()}) == [1, 2]
    assert sorted({r.doc for r in D.proximity(index, phrases, 7).collect()}) == [1, 2, 3]


def test_main_path_has_no_python(spark, capsys):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text")
    D.hits(docs, docs.withColumnRenamed("doc_id", "item_id")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
