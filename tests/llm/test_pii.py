import random
import re

import numpy as np
import pytest
from stagelens.llm import pii as P

EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("letters", ["a@.-b1 ", "0123456789 -", "+1().- 23", "1.2.55 .300", "a@a@.com "])
def test_base_spans(letters):
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert P.base_spans(t) == plain(t), t


def test_trees_on_other_examples():
    trees, steps, limits = P.model()
    made = P.examples(seed=5, many=2500)
    x, y = np.array([P.features(*e[:4]) for e in made], float), np.array([e[4] for e in made])
    yes = P.calibrated(steps, trees.score(x)) >= limits[x[:, 0].astype(int)]
    assert y[yes].mean() > 0.93 and yes[y].mean() > 0.85


def test_table(spark):
    rows = [(1, "mail a.b@c.de or é 4539 1488 0343 6467, call +1 (614) 555-8001 from 10.0.0.1", "x"), (None, None, None), (2, "", ""), (2, 'api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"', "")]
    got = {r.doc_id: r for r in P.detect(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect() if r.spans or r.doc_id is None}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].redacted == "mail [EMAIL] or é [CARD], call [PHONE] from [IP]"
    assert got[2].spans.startswith("secret:") and got[2].redacted == 'api_key = "[SECRET]"' and got[None].redacted == ""
    df = P.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert df.columns == ["doc_id", "text", "spans"] and [r.text for r in df.where("doc_id is null").collect()] == [None]
    assert P.detect(df.limit(0)).count() == 0


def test_overlaps_and_long_texts():
    assert P.redacted("abcdefghij", [("ip", 2, 5), ("card", 4, 8)]) == "ab[IP]ij"
    for t in ("1" * 100_000, "@" * 50_000, "1.1." * 20_000, "+1 " * 20_000, "token=" * 10_000, "a at " * 20_000):
        P.find([t], P.model())


@pytest.mark.parametrize("n", [40, 129, 300, 5000])
def test_long_secrets_go_whole(n):
    rng = random.Random(n)
    values = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(n)) for _ in range(20)]
    texts = [f'the config token="{v}" and more' for v in values]
    got = [P.redacted(t, spans) for t, (_, spans) in zip(texts, P.find(texts, P.model()), strict=True)]
    assert [g for g, v in zip(got, values, strict=True) if "[SECRET]" in g and g != 'the config token="[SECRET]" and more'] == []
    assert n < 129 or set(got) == {'the config token="[SECRET]" and more'}
