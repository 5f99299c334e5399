import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerflow.llm import token_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path(token_counts.VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return lambda text: len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def mine(texts):
    return token_counts.counted(token_counts.vocabulary(PATH), pa.array(texts, pa.string()))[1].tolist()


def test_query_equals_the_library(spark, sf, library):
    want = {d: (len((t or "").encode()), library(t or "")) for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    rows = token_counts.query(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)


CASES = [
    "", " ", "it's we'll they've I'm he'd you're can't", "'sister ''s !'s 's's 5's 'S 'LL 'rex 'r 'v e", "aaaa aaaaa aaaaaaa lalalala hahahahaha", "1234 ½ ٣٤ x1y2", "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext",
    "Straße İstanbul ΟΔΥΣΣΕΥΣ ǅ ﬀ", "é é ̈́ 가 각", "日本語テキスト 한국어 русский العربية", "😀👩‍👩‍👧 ‍﻿    x\x85y\x1cz\x00", "á<|endoftext|>́b", "...---!!!???''\"\"", "\t\r\n\x0b\x0c", "naïve café ﬁ ʼs ’s",
]


def test_awkward_texts(library):
    assert mine(CASES) == [library(t) for t in CASES]
    assert mine([None, "a", None]) == [0, 1, 0] and mine([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeinst'' 19.<|>́É"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_text(texts):
    assert mine(texts) == [len(TOKENIZER.encode(x, add_special_tokens=False).ids) for x in texts]


def test_long_words_and_cuts(library, monkeypatch):
    random.seed(5)
    words = ["".join(random.choices("etaoinshr", k=n)) for n in (255, 256, 257, 258, 5000)] + ["a" * 3001, "ab" * 900, "the" * 700]
    assert mine(words) == [library(w) for w in words]
    monkeypatch.setattr(token_counts, "LONG", 3)
    assert mine(CASES + words) == [library(t) for t in CASES + words]
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 64)
    mixed = [" ".join(random.choices(words[:1] + ["it's", "é́", "<|endoftext|>", "ß9", "word", " "], k=200)) for _ in range(5)]
    assert mine(mixed + words) == [library(t) for t in mixed + words]


def test_a_word_of_megabytes_is_quick():
    import time

    random.seed(6)
    word = "".join(random.choices("etaoinshrdlu", k=1_000_000))
    began = time.time()
    (n,) = mine([word])
    assert 200_000 < n < 700_000 and time.time() - began < 60


def test_awkward_rows(spark, awkward, library):
    more = awkward.withColumns({"n_tokens": F.lit("x"), "c0": F.lit(2), "body": F.lit(3), "other": F.lit(1)})
    out = token_counts.count_tokens(more.toDF(*more.columns[:-1], "Text"), "text", PATH)
    rows = out.collect()
    names = out.columns
    assert names[-3:] == ["n_bytes", "n_tokens", "over_limit"] and names.count("n_tokens") == 1 and "Text" in names
    got = sorted((str(r[names.index("doc_id")]), r[names.index("n_bytes")], r[names.index("n_tokens")]) for r in rows)
    assert got == sorted((str(r.doc_id), len((r.text or "").encode()), library(r.text or "")) for r in awkward.collect())
    assert token_counts.count_tokens(awkward.limit(0), "text", PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a byte-level"):
        token_counts.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_runs_of_one_pair():
    at = np.array([0, 1, 2, 5, 6, 9])
    assert token_counts.every_other(at, np.diff(at, prepend=-2) == 1).tolist() == [0, 2, 5, 9]
