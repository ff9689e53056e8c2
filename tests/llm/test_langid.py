import random

import numpy as np
from stagelens.llm import langid as L

WORDS = {"en": "the of and to in that was for".split(), "de": "der die und nicht für über schön ein".split()}


def rows(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "x") for i in range(n) for lang in [("en", "de")[i % 2]]]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score string")


def test_learns_and_answers(spark):
    data = rows()
    model = L.train(frame(spark, data))
    got = {r.doc_id: r for r in L.predict(frame(spark, data), model).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang, _ in data) and model.languages == ["de", "en"]
    odd = frame(spark, [(1, None, None, None), (2, "", "", ""), (3, "123 !!", "en", ""), (None, "the and of the", "en", ""), (4, "² ½", "en", "")])
    answers = {r.doc_id: (r.lang_pred, r.rejected, r.held_out) for r in L.predict(odd, model).collect()}
    assert answers[None][0] == "en" and all(answers[k][:2] == ("und", True) for k in (1, 2, 3, 4)) and answers[None][2] is False
    kept = L.accepted(odd, model)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [None]


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    data = rows()
    held = frame(spark, data).where(L.held_out())
    wrong = held.selectExpr("doc_id", "text", "'zz' as lang", "score")
    rest = frame(spark, data).where(~L.held_out())
    a, b = L.train(rest.unionByName(held)), L.train(rest.unionByName(wrong))
    assert b.languages == ["de", "en"] and np.array_equal(a.table, b.table)


def test_nothing_to_learn_from(spark):
    assert L.train(frame(spark, [])) is None and L.train(frame(spark, [(1, "a", None, "")])) is None
    (r,) = L.predict(frame(spark, [(1, "the", "en", "")]), None).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_buckets_do_not_cross_rows():
    one = np.frombuffer(b"abcd", np.uint8)
    two = np.frombuffer(b"abcdabcd", np.uint8)
    for x, y in zip(L.buckets(np.array([0, 4]), one), L.buckets(np.array([0, 4, 8]), two), strict=True):
        assert x.tolist() * 2 == y.tolist()


def test_letters_of_no_language_are_rejected(spark):
    data, rng = rows(), random.Random(4)
    model = L.train(frame(spark, data))
    junk = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(150)), None, "") for i in range(100)]
    assert L.predict(frame(spark, junk), model).where("rejected").count() >= 95
    assert L.predict(frame(spark, data), model).where("rejected").count() == 0


def test_fifty_languages_and_bounded_parts(spark, monkeypatch):
    """Every language is learned, and parts of a block give what the whole gives."""
    rng = random.Random(4)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(12)] for k in range(50)}
    data = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, "x") for i, lang in enumerate(sorted(words) * 24)]
    model = L.train(frame(spark, data))
    assert model.languages == sorted(words)
    texts = [t.encode() for _, t, _, _ in data[:60]] + [b""]
    offsets, raw = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.frombuffer(b"".join(texts), np.uint8)
    whole = model.probabilities(offsets, raw)
    assert np.mean([model.languages[p.argmax()] == r[2] for p, r in zip(whole, data, strict=False)]) > 0.75  # an even guess is 0.02
    monkeypatch.setattr(L, "CELLS", 50 * 37)
    assert np.allclose(model.probabilities(offsets, raw), whole, atol=1e-5)
