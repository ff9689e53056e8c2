import os
import re

import corpus_pipeline as C
import public_tokenizers
import tiktoken
from stagelens.llm import _common, bpe, near_dedup, pii
from stagelens.llm._common import table


def grams(text):
    """Windows of 13 words, or the whole of fewer."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()


def test_stages_against_plain_python(spark, sf_dir, tmp_path):
    """Each stage's rows from its own input; the classifier's stage may only drop rows."""
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in out.collect()}
        if name != "tokens":
            assert out.columns == columns
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
        elif name == "decontaminate":
            windows = {g for r in table(spark, sf_dir, "benchmark").collect() for g in grams(r.text)}
            bad = {d for d, r in before.items() if windows & grams(r.text)}
            assert bad and set(after) == set(before) - bad
        elif name == "pii":
            found = pii.find([r.text for r in before.values()], pii.model())
            assert {d: r.text for d, r in after.items()} == {d: pii.redacted(r.text, s) for (d, r), (_, s) in zip(before.items(), found, strict=True)}
        else:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
            assert {d: r.ids for d, r in after.items()} == {d: own.encode_ordinary(r.text) for d, r in before.items()}
        docs, before = out, after


def test_run_gives_every_row_once(spark, sf_dir):
    got = C.run(spark, sf_dir)
    assert got.count() == got.select("doc_id").distinct().count() > 0


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __bad long, ids string"
    docs = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", None, "", 0, 1, ""), (1, "the cat", "en", "", 1, 1, ""), (1, "the cat", "en", "", 1, 1, "")], schema)
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, "the cat", "x"), (2, None, None)], "item_id long, text string, __bad string").write.parquet(str(bench))
    for name, stage in C.STAGES:
        # "the cat" is a whole item of the benchmark, and rows of one id go together; texts without a letter have no language.
        assert stage(spark, docs, str(tmp_path)).count() == {"language": 2, "decontaminate": 1}.get(name, 4), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_kernels_give_memory_back(spark, tmp_path, monkeypatch):
    """At the end of a partition each kernel of the pipeline returns what its worker holds without use."""
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "en", "", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    kernels, whole = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: kernels.append(f) or whole(self, f, *a, **b))
    for name, stage in C.STAGES:
        if name != "decontaminate":  # has no kernel
            before = len(kernels)
            stage(spark, docs, str(tmp_path))
            assert len(kernels) > before, name
    calls = []
    monkeypatch.setattr(_common, "give_back", lambda: calls.append(1))
    for n, kernel in enumerate(kernels, 1):
        assert not list(kernel(iter([]))) and len(calls) == n


def test_freed_memory_goes_back_to_the_system():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    last = []

    def run(batches):
        some = [bytearray(1000) for _ in range(100_000)]
        last.append(some[-1])  # the heap's end stays in use, so free() alone returns nothing
        yield held()

    before = held()
    (peak,) = _common.tidy(run)(iter([]))
    assert peak > before + 80 and held() < before + 40
