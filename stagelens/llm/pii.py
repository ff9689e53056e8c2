"""Personal data: candidate spans by high-recall generators, judged by calibrated gradient-boosted trees.

Base spans (email, ip, card, phone in their plain forms) are fixed by rule and always stay. Generators propose
further, possibly overlapping spans; boosted trees score each from its format and context; a probability from
isotonic calibration on held-out examples is compared with its kind's threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from .boosting import Boosted, isotonic

BASE = ("email", "ip", "card", "phone")
#: Further kinds that only the trees accept.
KINDS = ("email", "phone", "card", "ip", "iban", "ssn", "mac", "secret")
#: The precision that each kind's threshold has on held-out examples, and the examples that training makes.
PRECISION, EXAMPLES = 0.98, 6_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: High-recall generators of further candidates: (kind, what a text must hold in lower case, pattern).
_GENERATORS = [
    ("email", ("(at)", "[at]", " at "), re.compile(r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}+[\x20]?(?:\(at\)|\[at\]|[\x20]at[\x20])[\x20]?[a-z0-9-]{1,63}+(?:[\x20]?(?:\(dot\)|\[dot\]|[\x20]dot[\x20])[\x20]?[a-z0-9-]{2,63}+|\.[a-z0-9-]{2,63}+){1,4}+")),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)[\x20]?|00[0-9])[0-9][0-9\x20.()/-]{5,16}[0-9](?![0-9A-Za-z])")),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])")),
    ("ssn", None, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("card", None, re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])")),
    ("iban", None, re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?\b")),
    ("ip", (":",), re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])")),
    ("mac", (":", "-"), re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")),
    ("secret", ("token", "secret", "passw", "key", "pwd"), re.compile(r"(?i)(?:token|secret|passwor[dt]|passwd|pwd|api[_-]?key|access[_-]?key|key)[\"']?[\x20]?[=:][\x20]?[\"']?(?P<value>[A-Za-z0-9+/_.-]{8,}+)")),
]
_CUES = re.compile(r"(?i)mail|contact|write|call|phone|tel|mobile|fax|ssn|social|security|card|visa|pay|iban|bank|account|ip|host|server|addr|mac|device|token|secret|password|key")
_COUNTER = re.compile(r"(?i)version|isbn|order|invoice|page|chapter|total|price|section|build|ratio|score|serial|part|meet|look|stay|see|was|were|is")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, by kind as listed, then by start; leftmost and without overlap in each kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap."""
    low, digit, out = None, _DIGIT.search(text) is not None, []
    for kind, needs, pattern in _GENERATORS:
        if needs is None or kind in ("ip", "mac"):
            if not digit or needs and not any(x in text for x in needs):
                continue
        else:
            low = text.lower() if low is None else low
            if not any(x in low for x in needs):
                continue
        out += [(kind, *m.span("value" if kind == "secret" else 0)) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span and words around it."""
    span, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 24]
    size = len(span)
    digits = [c for c in span if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in span)
    groups = re.split(r"[^0-9A-Za-z]+", span.strip("()"))
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    cue, counter = list(_CUES.finditer(before)), list(_COUNTER.finditer(before))
    return [
        KINDS.index(kind), size, len(digits), letters, len(digits) / size, hexes / size, len(set(span)) / size, len(groups), max(map(len, groups)), min(map(len, groups)),
        span.count("."), span.count("-"), span.count(" "), span.count(":"), "(" in span or "[" in span, bool(digits) and luhn("".join(digits)),
        _checksum(span) if kind == "iban" else -1, any(c.isupper() for c in span), len(cue), 48 if not cue else len(before) - cue[-1].end(), len(counter), 48 if not counter else len(before) - counter[-1].end(),
        before[-1:].isalnum(), after[:1].isalnum(), "=" in before[-6:] or ":" in before[-6:], '"' in before[-2:] or "'" in before[-2:], kind == "email" and bool(re.search(r"(?i)dot|\.[a-z]", span)),
        kind == "email" and bool(re.search(r"(?i)[\x20]at[\x20]", span)), kind == "email" and bool(re.search(r"(?i)(?:com|net|org|edu|io|de|fr|es)$", span)),
    ]


def _checksum(iban: str) -> bool:
    text = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def examples(seed: int = 11, many: int = EXAMPLES) -> list[tuple[str, str, int, int, bool]]:
    """Made sentences with true spans and look-alikes, each candidate with its truth."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    some = lambda chars, n: "".join(chars[int(i)] for i in rng.integers(0, len(chars), n))
    digits, hexa, low = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    filler = [some(low, int(n)) for n in rng.integers(2, 9, 300)] + ["the", "and", "of", "to", "was", "is", "at", "dot", "de", "la", "und", "que"] * 8

    def words(n: int) -> str:
        return " ".join(pick(*filler) for _ in range(n))

    def iban(valid: bool) -> str:
        land, rest = pick("DE", "FR", "ES", "GB", "NL"), some(digits, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        check = check if valid else (check + int(rng.integers(1, 90))) % 97
        return f"{land}{check:02d}{rest}"

    def card(n: int, valid: bool) -> str:
        head = some(digits, n - 1)
        good = next(d for d in digits if luhn(head + d))
        return head + (good if valid else pick(*[d for d in digits if d != good]))

    def one() -> tuple[str, str, bool]:
        k, true = pick(*KINDS), bool(rng.integers(2))
        if k == "email":
            a, b, c = some(low, int(rng.integers(3, 9))), some(low, int(rng.integers(3, 9))), pick("com", "net", "org", "de", "fr", "io")
            if true:
                return pick("mail", "contact", "write to", words(1)), pick(f"{a} (at) {b} (dot) {c}", f"{a}[at]{b}[dot]{c}", f"{a} at {b} dot {c}", f"{a}.{some(digits, 2)} at {b} dot {c}", f"{a} [at] {b}.{c}"), True
            return pick("meet", "look", words(2), "was"), pick(f"{a} at {b}. {some(low, 5)}", f"{a} at {b}.{some(low, 6)}", f"{a} at {b}.{some(low, 4)}"), False
        if k == "phone":
            if true:
                return pick("call", "phone", "tel", "mobile:", words(1)), pick(f"({some(digits, 3)}) {some(digits, 3)}-{some(digits, 4)}", f"{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)}", f"00{some('123456789', 2)} {some(digits, 3)} {some(digits, 6)}"), True
            return pick("order", "invoice", "total", "serial", "part"), pick(f"{some(digits, 3)}.{some(digits, 3)}.{some(digits, 4)}", f"{some(digits, 3)} {some(digits, 4)} {some(digits, 4)}", f"({some(digits, 4)}) {some(digits, 4)}.{some(digits, 4)}"), False
        if k == "card":
            return pick("card", "visa", "pay with", words(1)) if true else pick("serial", "order", words(2)), card(pick(13, 14, 15), true), true
        if k == "ssn":
            return pick("ssn", "social security", "ssn:") if true else pick("part", "order", "serial", "section"), f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}", true
        if k == "iban":
            return pick("iban", "bank account", words(1)), iban(true), true
        if k == "ip":
            return (pick("host", "server", words(1)), ":".join(some(hexa, 4) for _ in range(8)), True) if true else (pick("at", "score", "ratio", words(1)), ":".join(some(digits, 2) for _ in range(3)), False)
        if k == "mac":
            return (pick("device", "mac", words(1)), ":".join(some(hexa, 2) for _ in range(6)), True) if true else (pick("section", "part", "build"), "-".join(some(digits, 2) for _ in range(6)), False)
        lead = pick("token = \"", "api_key: ", "secret=", "password = '", "token=\"", "key: ")
        if rng.integers(3) == 0:  # tokens, keys and names that may run on
            many = pick(24, 40, 64, 100, 200, 400)
            return lead, some(low.upper() + low + digits + "+/_-.", many - 1) + "a" if true else pick("_", "/", ".", "-").join(words(max(2, many // 6)).split()), true
        return lead, (some(hexa, pick(24, 32, 40, 64)) if rng.integers(2) else some(low + digits + "ABCDEFGHKLM", pick(16, 24, 40))) if true else pick(some(low, int(rng.integers(8, 14))), words(1) + "ication"), true

    out = []
    while len(out) < many:
        lead, span, true = one()
        text = f"{words(int(rng.integers(1, 7)))} {lead}{'' if lead[-1] in '"' + chr(39) + '=' else ' '}{span}"
        at = len(text) - len(span)
        text += pick('"', "", "'") + pick("", " ", ".", ", ") + words(3) if lead[-1] in "\"'" else pick(" ", ". ", ", ") + words(int(rng.integers(1, 6)))
        for kind, a, b in candidates(text):
            same = min(b, at + len(span)) - max(a, at) >= 0.8 * (b - a) and b - a >= 0.6 * len(span)
            out.append((text, kind, a, b, true and same))
    return out


@lru_cache(1)
def model() -> tuple[Boosted, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Trees, calibration and each kind's threshold; two thirds of the examples are for the trees, the rest for
    calibration and thresholds."""
    made = examples()
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in made], float)
    y = np.array([z[-1] for z in made], float)
    held = np.arange(len(made)) % 3 == 2
    trees = Boosted().fit(x[~held], y[~held])
    score = trees.score(x[held])
    steps = isotonic(score, y[held])
    p = calibrated(steps, score)
    limits = np.full(len(KINDS), 2.0)
    for k in range(len(KINDS)):
        own = x[held][:, 0] == k
        for limit in np.unique(p[own]):
            if limit >= 0.5 and y[held][own][p[own] >= limit].mean() >= PRECISION:
                limits[k] = limit
                break
    return trees, steps, limits


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return steps[1][np.maximum(np.searchsorted(steps[0], score, "right") - 1, 0)]


def find(texts: list[str], fitted) -> list[tuple[list, list]]:
    """(base spans, all spans) for each text; an added span that a base or a better added span overlaps goes."""
    trees, steps, limits = fitted
    base = [base_spans(t) for t in texts]
    more = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    added: list[list] = [[] for _ in texts]
    if more:
        x = np.array([features(texts[i], k, a, b) for i, k, a, b in more], float)
        p = calibrated(steps, trees.score(x))
        for j in np.argsort(-p, kind="stable").tolist():
            i, kind, a, b = more[j]
            if p[j] >= limits[KINDS.index(kind)] and not any(a < e and s < b for _, s, e in base[i] + added[i]):
                added[i].append((kind, a, b))
    order = {k: n for n, k in enumerate(dict.fromkeys(BASE + KINDS))}
    return [(own, sorted(own + new, key=lambda s: (order[s[0]], s[1], s[2]))) for own, new in zip(base, added, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first,
    and of these the longest, names the whole stretch."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[max(at, end) : a], f"[{kind.upper()}]"]
            at = end = b
        else:
            at = end = max(end, b)
    return "".join([*out, text[end:]])


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, redacted) for each row of docs.

    Counts and digest are of the base spans; spans are all of them as kind:start:end in code points, end exclusive,
    in the order of kinds and then starts. Null counts as empty and has none. Rows aren't joined or grouped, so
    repeated and null doc_ids pass through; other columns aren't read.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [x or "" for x in part["text"].to_pylist()]
                found = find(texts, fitted.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                columns = [part["doc_id"], *counts, digest, pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "redacted"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; other columns and their order stay, null stays null."""
    fitted, schema = docs.sparkSession.sparkContext.broadcast(model()), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column(at).to_pylist()
                found = find([x or "" for x in texts], fitted.value)
                new = pa.array([None if t is None else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())
                columns = list(part.columns)
                columns[at] = new
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(tidy(run), schema)
