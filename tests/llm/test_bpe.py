import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and\tlines\r\n "), (5, "it's I'LL we'd 12345 ¼½ ٣٤"), (6, "naïve café 日本語 한국어 العربية \U0001f600\U0001f468‍\U0001f469"),
    (7, "<|endoftext|> [PAD] </s>"), (8, "a" * 2500), (9, "ab" * 700 + " tail"), (10, "x\x00y\x1cz\x85w\xa0v u　t"), (10, "x\x00y\x1cz\x85w\xa0v u　t"), (11, "!!!???***" * 50), (12, " lead"), (13, "trail "), (14, "word\nword \n word"), (15, "é́é ﻿ ok"),
]


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("held", [0, 3, 500_000])
def test_against_the_library(spark, enc, held):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice("aeinorst  \n.,'1é日#") for _ in range(rng.randrange(120)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "word", "n", "rare")})
    want = sorted((i, enc.encode_ordinary(t or "")) for i, t in rows)
    ids = bpe.encode(docs, PATH, P.PATTERN, held=held)
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == want
    texts = sorted((i, t or "") for i, t in rows)
    assert sorted((r.doc_id, bytes(r.b).decode()) for r in ids.select("doc_id", bpe.decode(F.col("ids"), bpe.read_ranks(PATH)).alias("b")).collect()) == texts
    back = bpe.encode(docs, PATH, P.PATTERN, held=held, with_ids=False).collect()
    assert sorted(map(tuple, back)) == sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), [x for _, x in want], strict=True))


def test_documents_and_empty_table(spark, sf, enc):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, PATH, P.PATTERN).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_heap_merges_like_the_fold(enc):
    rng = random.Random(2)
    ranks = bpe.read_ranks(PATH)
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for n in (1, 2, 7, 60, 900):
        for letters in ("ab", "the an", "éèaou"):
            w = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.merged_with_heap(w.encode(), ranks) == whole.encode_ordinary(w)


@pytest.mark.parametrize("pattern", [r"\p{Lu}?\p{Ll}+|[\s\S]", r"\S+|\s+"])
@pytest.mark.parametrize("held", [0, 500_000])
def test_other_patterns_match_whole_texts(spark, pattern, held):
    """A pattern that splits at capitals, and one whose words have no space before them."""
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rows = [*ODD, (20, "camelCase HTTPServer one.Two a,b c. d"), (21, "x  Y z ")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, pattern, held=held)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, other.encode_ordinary(t or "")) for i, t in rows)


def test_chunks_of_texts():
    import re

    white = re.compile(r"\s")
    assert bpe.PATTERN == P.PATTERN
    # Arrow's class of white space is Python's
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    near = pc.match_substring_regex(pa.array([f"a {c}" for c in every]), bpe._NEAR).to_pylist()
    assert near == [bool(white.match(c)) for c in every]
    assert pc.match_substring_regex(pa.array(["a\u2003 b", "a b", " a", "a ", ""]), bpe._NEAR).to_pylist() == [True, False, False, False, False]
    order, lists = bpe.chunk_lists(pa.array(["a  b c", "", "a b", " ", "x \n y", " a "]))
    assert order.tolist() == [1, 2, 3, 5, 0, 4]
    assert lists.to_pylist() == [[""], ["a", "b"], ["", ""], ["", "a", ""], ["a  b", "c"], ["x \n y"]]
    order, lists = bpe.chunk_lists(pa.array([], pa.string()))
    assert len(order) == len(lists) == 0
