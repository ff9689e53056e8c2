import math
import random

import numpy as np
from stagelens.llm import toxicity as T


def data(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        words = [rng.choice([f"w{chr(97 + k)}x" for k in range(20)]) for _ in range(40)]
        words[5] = rng.choice(["idiot", "moron"]) if toxic else "kind"
        docs.append((i, " ".join(words) + (" !!! ??? ###" * 5 if low else ""), "x"))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = data()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = T.train(d.where("doc_id < 400"), lab)
    assert chain.categories == ["low_quality", "toxic"] and len(chain.weights[1]) == len(chain.weights[0]) + 1
    got = {r.doc_id: r for r in T.classify(d, chain).collect()}
    held = [x for x in labels if x[0] >= 400]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in held]) > 0.97 and np.mean([got[i].low_quality == (q == 0) for i, q, _ in held]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x " * 50_000)], "doc_id long, text string")
    none = T.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none is None and [r.toxic for r in T.classify(docs, none).collect()] == [False] * 3
    one = T.train(docs, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int"))
    assert T.classify(docs, one).count() == 3 and T.classify(docs.limit(0), one).count() == 0


def plain_predict(chain, text):
    """The chain by plain Python: words, style, then each model on what came before it."""
    x = [0.0] * len(chain.vocabulary)
    for w in T.words(text):
        if w in chain.vocabulary:
            x[chain.vocabulary[w]] = 1.0
    x += T.style(text)
    out = []
    for w in chain.weights:
        z = sum(float(a) * b for a, b in zip(w, [*x, 1.0], strict=True))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        x.append(out[-1])
    return out


def test_predictions_against_plain_python(spark):
    docs, labels = data(300, 3)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = T.train(d, lab)
    assert chain.vocabulary and {"idiot", "moron"} <= chain.vocabulary.keys()
    for r in T.classify(d, chain).collect():
        want = plain_predict(chain, docs[r.doc_id][1])
        assert np.allclose([r.p_low_quality, r.p_toxic], want, atol=1e-6)
        assert (r.low_quality, r.toxic) == tuple(bool(p >= t) for p, t in zip([r.p_low_quality, r.p_toxic], chain.thresholds, strict=True))


def test_clashing_labels_and_several_texts_of_one_id(spark):
    """Clashing labels count as true, however rows are dealt; copies of a text share a fold."""
    docs, labels = data(200, 5)
    docs = docs + [(i, docs[0][1], "x") for i in range(200, 240)] + [(0, "another text of an id", "x")]
    labels = labels + [(i, 1, 1 - t) for i, _, t in labels[:50]]
    lab = [spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n) for x, n in ((labels, 1), (labels[::-1], 4))]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    one, two = (T.train(d.repartition(n), x) for n, x in ((1, lab[0]), (3, lab[1])))
    assert one.vocabulary == two.vocabulary and one.thresholds == two.thresholds and all(np.allclose(a, b, atol=1e-4) for a, b in zip(one.weights, two.weights, strict=True))
