import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from stagelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    DATA = f.read()
CODEC = bpe.codec(DATA, public_tokenizers.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(DATA), special_tokens={})


def encoded(texts):
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    out, ids = CODEC.encode(ends, np.frombuffer(b"".join(raw), np.uint8))
    return [ids[a:b].tolist() for a, b in zip(out[:-1], out[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab cé×÷ñß'srtl \n\t\x0b\x1c\x1f\x85\xa0 ​　漢1²½,.!🎉<|>"), max_size=40), max_size=4))
def test_like_tiktoken(texts):
    got = encoded(texts)
    assert got == [TRUE.encode_ordinary(t) for t in texts]
    for ids, t in zip(got, texts, strict=True):
        assert CODEC.decode(np.array(ids, np.int32))[1].tobytes() == t.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "ab" * 300, "1" * 257, " " * 700, "the cat " * 300, "x  y ", "\n\n \n a", "é" * 400, "<|endoftext|>", "don't we'll I'd", "word " * 5 + "'s"])
def test_long_and_odd_texts(text):
    assert encoded([text, "x", text]) == [TRUE.encode_ordinary(text), TRUE.encode_ordinary("x"), TRUE.encode_ordinary(text)]


def test_rows_of_a_table(spark):
    rows = [(1, "Hello world", 7), (1, "Hello world", 7), (None, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in got) == [("1", 2, b"Hello world"), ("1", 2, b"Hello world"), ("2", 0, b""), ("None", 0, b"")]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\p{N}{1,3}|\p{L}+|[^\p{L}\p{N}]", r"\p{Lu}?\p{Ll}+|\s|."])
def test_other_patterns_against_tiktoken(pattern):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    own, theirs = bpe.Codec(data, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    texts = ["Plain words and 12345 numbers, HELLOworld it's", "", "a\n\nb  c", "éß 日本 १२३"]
    raw = [t.encode() for t in texts]
    ends, ids = own.encode(np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [theirs.encode_ordinary(t) for t in texts]


def test_the_fast_path_is_for_the_pattern_of_the_vocabulary():
    assert bpe.RUNS == public_tokenizers.PATTERN
