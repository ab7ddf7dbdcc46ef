"""Byte-level BPE by forced boundaries against the public library."""

import hashlib
import random

import numpy as np
import pytest

from boxloom.llm import bpe as B


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.load()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(B.FILE))


ALPHABET = ["a", "b", "the", "in g", " ", "  ", "\n", "\t", "'s", "'ll", "'", "é", "漢字", "\x00", "ing", "er", "😀", "Ġ", "1", "2024", " ", "\u0085", "\x1c",
            "<|endoftext|>", "<|endof", "|>", "²", "ſ", "‍", "---", "====", "_", "Übermut"]


def texts(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "   x", "x   ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b"]


def test_same_ids_as_the_library(vocabulary, public):
    encoder = B.Encoder(vocabulary)
    given = texts()
    ids, cuts = encoder.encode(given)
    wanted = public.encode_batch(given, add_special_tokens=False)
    for t, a, b, w in zip(given, cuts[:-1], cuts[1:], wanted, strict=True):
        assert ids[a:b].tolist() == w.ids, t
        assert B.decode(ids[a:b], np.array(vocabulary.spelled, object)) == public.decode(w.ids, skip_special_tokens=False) == t


def test_every_kind_of_character(vocabulary, public):
    """Letters, numbers and spaces are told apart as the library does, over the whole basic plane."""
    given = ["".join(f"x{chr(c)}  {chr(c)}1 " for c in range(k, k + 64)) for k in range(0, 0x10000, 64) if not 0xD800 <= k < 0xE000]
    ids, cuts = B.Encoder(vocabulary).encode(given)
    for a, b, w in zip(cuts[:-1], cuts[1:], public.encode_batch(given, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == w.ids


def test_fragments_alone_and_together(vocabulary):
    """A fragment gives the same ids whatever stands beside it, side by side or with the heap."""
    r = random.Random(3)
    raw = [bytes(r.choice(b"abetnrs aaaaeE\xc3\xa9") for _ in range(r.randint(1, 40))) for _ in range(500)]
    flat = vocabulary.first[np.frombuffer(b"".join(raw), np.uint8)]
    ids, count = B.merge_all(flat, np.array([len(x) for x in raw]), vocabulary)
    ends = np.cumsum(count)
    for x, a, b in zip(raw, ends - count, ends, strict=True):
        alone = B.merge_one(vocabulary.first[np.frombuffer(x, np.uint8)].tolist(), vocabulary)
        assert ids[a:b].tolist() == alone
        assert b"".join(vocabulary.spelled[i] for i in alone) == x


def test_cuts_are_certain(vocabulary):
    """No token of the vocabulary reaches over a certain cut, and texts really have some."""
    for token in vocabulary.spelled[:50256]:
        x = np.frombuffer(token, np.uint8)
        assert vocabulary.inside[x[:-1], x[1:]].all()
    _, size, count = B.fragments(["qzjxé漢", "the"], vocabulary)
    assert count[0] > 1 and count[1] == 1 and size.sum() == len("qzjxé漢the".encode())


def test_long_piece(vocabulary, public):
    r = random.Random(4)
    given = ["".join(r.choice("etaoinshrdlu") for _ in range(30_000)), "a" * 50_000, "漢" * 5000, "word " * 50_000]
    ids, cuts = B.Encoder(vocabulary).encode(given)
    for a, b, w in zip(cuts[:-1], cuts[1:], public.encode_batch(given, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == w.ids


def test_memory_that_starts_anew(vocabulary, public, monkeypatch):
    monkeypatch.setattr(B, "KNOWN", 30)
    encoder = B.Encoder(vocabulary)
    for seed in range(6):
        given = texts(seed, 20)
        ids, cuts = encoder.encode(given)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [w.ids for w in public.encode_batch(given, add_special_tokens=False)]


def test_round_trip(spark, vocabulary, public):
    given = texts(5, 200) + [None, "word " * 300_000, "z" * 5000]
    rows = [(i, t, 1, "r") for i, t in enumerate(given)] + [(None, "x", 1, "r"), (3, given[3], 1, "r"), (3, given[3], 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string").repartition(3)
    back = B.bpe_decode(B.bpe_encode(df, vocabulary), vocabulary)
    got = B.token_digests(back).collect()
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for i, t, *_ in rows:
        ids = public.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), hashed(",".join(map(str, ids))), hashed(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert B.bpe_decode(B.bpe_encode(df.limit(0), vocabulary), vocabulary).collect() == []


def test_decoding_of_other_ids(spark, vocabulary, public):
    r = random.Random(6)
    rows = [(i, [r.randint(0, 50256) for _ in range(r.randint(0, 20))]) for i in range(50)] + [(50, None), (51, [None, 5])]
    got = B.bpe_decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocabulary).collect()
    wanted = {i: public.decode([x for x in ids or [] if x is not None], skip_special_tokens=False) for i, ids in rows}
    assert {x.doc_id: x.text for x in got} == wanted
