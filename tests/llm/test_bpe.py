import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actloom.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/{bpe.BYTE_BPE}"


with open(PATH, "rb") as _f:
    ORACLE = tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)}, special_tokens={}).encode_ordinary


@pytest.fixture
def reference():
    return ORACLE


ENCODER = bpe.TrieEncoder(PATH, memo_bytes=20_000)


def flat(text):
    return [i for w in next(iter(ENCODER.encode([text]))) for i in w]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_is_encoded_as_by_the_public_library(text):
    assert flat(text) == ORACLE(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, " \n\n\t x", "don't 12345", "承包单位是否可以变更期限？", "\x00￿🙂‍⚖️", "ก็ไม่ทราบ"])
def test_hard_texts(reference, text):
    assert flat(text) == reference(text)


def test_memo_starts_anew_when_full(reference):
    small = bpe.TrieEncoder(PATH, memo_bytes=500)
    texts = [f"word{i} other{i}" for i in range(200)]
    got = [[i for w in ws for i in w] for ws in small.encode(texts, block_chars=50)]
    assert got == [reference(t) for t in texts]


def test_columns(spark, reference):
    df = spark.createDataFrame([(1, "two words", "x"), (2, "", "x"), (3, None, "x"), (1, "two words", "x")], "doc_id bigint, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    assert rows == [(1, reference("two words"))] * 2 + [(2, []), (3, [])]
    assert [r.n for r in df.orderBy("doc_id").select(bpe.token_count(F.col("text")).alias("n")).collect()] == [2, 2, 0, 0]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
