import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from oracle import same
from stagelens.llm import bpe, queries
from stagelens.llm.transport import padded


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], sf_dir)


def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1_takes_the_articles(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op1_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id].html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op3_against_plain_python(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for r in queries.op3_transport_stream(spark, sf_dir).collect():
        raw = docs[r.doc_id].text.encode()
        payload = padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes % 188 == 0 and "continuity_errors=0" in r.feature


def test_op4_against_tiktoken(spark, sf_dir):
    docs = documents(spark, sf_dir)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op4_byte_bpe(spark, sf_dir).collect():
        ids = own.encode_ordinary(docs[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest()


def test_op8_on_held_out_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = queries.op8_language(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_op10_on_its_labels(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(got[d].toxic for d in clean) <= 0.1 * len(clean)
