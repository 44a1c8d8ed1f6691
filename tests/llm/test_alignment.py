"""Alignment against a plain walk over both token lists, with the library's own tokenizer for the first side."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import alignment

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ARGS = (RANKS, public_tokenizers.PATTERN, MODEL)


def byte_of() -> dict[str, int]:
    """Characters of a byte-level vocabulary and the bytes that they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def spans(tokens: list[bytes]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return [(e - len(t), e) for t, e in zip(tokens, ends, strict=True)]


def brute_force(docs: list[tuple]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second, chars = sentencepiece.SentencePieceProcessor(model_file=MODEL), byte_of()
    vocabulary = {i: bytes(chars[c] for c in t) for t, i in first.get_vocab().items() if all(c in chars for c in t)}
    rows, held = [], collections.Counter()
    for doc, text in docs:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes, b_bytes = [vocabulary[i] for i in a], [alignment.piece_bytes(second.id_to_piece(i)) for i in b]
        if text and not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans(a_bytes)) for j, (t, f) in enumerate(spans(b_bytes)) if s < f and t < e] if len(a) < 400 else None
        a_at, b_at = spans(a_bytes), spans(b_bytes)
        if links is None:  # the same in one walk
            links, j = [], 0
            for i, (s, e) in enumerate(a_at):
                while b_at[j][1] <= s:
                    j += 1
                k = j
                while k < len(b_at) and b_at[k][0] < e:
                    links.append((a[i], b[k]))
                    k += 1
        cuts = {e for _, e in a_at} & {e for _, e in b_at}
        groups = [[[], []] for _ in range(len(cuts) + 1)]
        for side, (ids, at) in enumerate(((a, a_at), (b, b_at))):
            g = 0
            for i, (_, e) in zip(ids, at, strict=True):
                groups[g][side].append(i)
                g += e in cuts
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups[:-1])
        rows.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(said.encode()).hexdigest() if a else "", said))
        held.update(set(links))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(doc, a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), digest, said) for doc, a, b, g, links, digest, said in rows]


ODD = [
    (1001, None), (1002, ""), (1003, " "), (1004, "two  spaces and ﬁ ligature"), (1005, "x <|endoftext|> <s> y"), (None, "日本語 テキスト 🎉 é"),
    (1007, "a"), (1008, "\n\n a\tb"), (5, "a"), (1009, "▁x"), (1010, "word " * 5_000 + "end"), (1007, "a"), (1011, "z" * 3_000),
]


@pytest.mark.parametrize("block_bytes", [20_000, 16 << 20])
def test_equals_a_plain_walk(spark, sf, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()] + ODD
    got = alignment.aligned(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), *ARGS)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_force(docs)))


def test_pair_counts(spark):
    docs = [(1, "the same"), (2, "the same"), (3, "other words here")]
    got = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(spark.createDataFrame(docs, "doc_id long, text string"), *ARGS).collect()}
    links = [{(a, b)} for a, b in got]
    assert links and max(n for n, _ in got.values()) == 2
    for (a, _), (n, best) in got.items():
        assert best == (n == max(m for (x, _), (m, _) in got.items() if x == a))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, *ARGS).count() == 0
    docs = spark.createDataFrame([(1, "some text", 7, "x", 3)], "doc_id long, text string, block long, groups string, place long")
    got = alignment.aligned(docs, *ARGS, with_groups=False).collect()
    assert got[0].doc_id == 1 and got[0].n_a == 2 and "groups" not in got[0]


def test_union_find_on_random_graphs():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (200, 150), (500, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        assert np.array_equal(alignment.union_find(n, u, v), label)
