"""Streaming piece search: exact round trips, the same path as the public unigram encoder, bounded memory."""

import random

import numpy as np
import pytest

from boxloom.llm import pieces as PC


@pytest.fixture(scope="module")
def vocabulary():
    return PC.Vocabulary.load()


ALPHABET = ["a", "b", "the", "in g", " ", "  ", "\n", "▁", "é", "漢", "\x00", "ing", "er", "\t", "😀", "Ġ", "1", "2024", "<s>", "<0x0A>"]


def test_window_and_columns_agree(vocabulary):
    r = random.Random(1)
    searcher = PC.Searcher(vocabulary)
    words = ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    ids, sizes = searcher.many(words)
    assert ids.tolist() == [i for w in words for i in PC.window_search(w, vocabulary)]
    assert sizes.tolist() == [len(list(PC.window_search(w, vocabulary))) for w in words]


def test_same_paths_as_the_public_encoder(vocabulary):
    """The library's own unigram search on the same pieces and scores finds paths of the same score."""
    sentencepiece = pytest.importorskip("sentencepiece")
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(PC.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = vocabulary.score[i]
    public = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    r = random.Random(2)
    words = ["thand", "entation", "überlegung", "la", "of", "réunion", "x9", "the"]
    searcher = PC.Searcher(vocabulary)
    total = lambda ids: sum(vocabulary.score[i] for i in ids)
    for _ in range(300):
        text = " ".join(r.choice(words) + r.choice(words) for _ in range(r.randint(1, 20)))
        ids, _ = searcher.encode([text])
        assert total(ids.tolist()) == pytest.approx(total(public.encode(text)), rel=1e-5)


def test_window_stays_small(vocabulary):
    """Ids are committed while the text goes on: an endless part needs no endless memory."""
    r = random.Random(3)

    class Part(str):
        furthest = 0

        def __getitem__(self, k):
            Part.furthest = max(Part.furthest, k)
            return str.__getitem__(self, k)

    part = Part("".join(r.choice("abcdefgh") for _ in range(20_000)))
    ids, settled, behind = [], 0, 0
    for i in PC.window_search(part, vocabulary):
        ids.append(i)
        behind = max(behind, Part.furthest - settled)
        settled += len(vocabulary.text[i])
    assert PC.decode(np.array(ids), vocabulary) == str(part).encode()[1:]
    assert behind < 40 * vocabulary.longest


def test_round_trip(spark, vocabulary):
    r = random.Random(4)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", " ", "word " * 50_000, "z" * 5000]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "x", 1, "r"), (3, texts[3], 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, round_trip string")
    got = PC.sentencepiece(df, vocabulary).collect()
    assert len(got) == len(rows) and all(x.round_trip for x in got)
    assert all(len(x.ids) == x.n_ids and x.n_bytes == len((dict((a, b) for a, b, *_ in rows)[x.doc_id] or "").encode()) for x in got)
    assert PC.sentencepiece(df.limit(0), vocabulary).collect() == []


def test_cache_that_overflows(vocabulary, monkeypatch):
    monkeypatch.setattr(PC, "CACHE", 50)
    searcher, fresh = PC.Searcher(vocabulary), None
    r = random.Random(5)
    for _ in range(30):
        texts = [" ".join(str(r.randint(0, 999)) for _ in range(20)) for _ in range(4)]
        ids, cuts = searcher.encode(texts)
        assert [PC.decode(ids[a:b], vocabulary).decode() for a, b in zip(cuts[:-1], cuts[1:])] == texts
