import math
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from cartwright.llm.sentence_pieces import (
    UNIGRAM,
    PieceModel,
    decode_pieces,
    default_model,
    encode_pieces,
)
from cartwright.llm.tables import table


def proto(kind=None):
    with open(default_model(), "rb") as file:
        raw = file.read()
    if kind is None:
        return raw
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    model.trainer_spec.model_type = kind
    for rank, piece in enumerate(model.pieces):
        piece.score = -math.log(rank + 2)
    return model.SerializeToString()


def texts_of(vocabulary):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b   c", "\n\n x\n", "Ж😀 tail ", "▁▁x", "hello\tworld", " " * 40 + "a" + " " * 23]
    pool = " ab\ncdetheing▁éß中😀1.,_-"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    names = list(vocabulary.ids)
    texts += ["".join(rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    return texts


def numbers(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_merge_model_equals_the_library(spark, sf):
    vocabulary = PieceModel(proto())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto())
    texts = texts_of(vocabulary) + [r.text for r in table(spark, sf, "documents").collect()]
    for text, raw, want in zip(texts, vocabulary.encode(texts), library.encode(texts)):
        assert numbers(raw) == want, repr(text)
        assert vocabulary.decode(want) == library.decode(want)


def test_unigram_model_reaches_the_best_score():
    vocabulary = PieceModel(proto(UNIGRAM))
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("theingaorsé中") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    found = vocabulary.encode_words(words)
    for word in words:
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                score = vocabulary.scores.get(word[begin:end])
                if score is None and end - begin == 1:
                    score = vocabulary.unknown_score
                if score is not None:
                    best[end] = max(best[end], best[begin] + score)
        ids = numbers(found[word])
        assert vocabulary.decode(ids) == word[1:]
        own = sum(vocabulary.score_of[i] for i in ids if i in vocabulary.text_of)
        lost = sum(c not in vocabulary.scores for c in word)
        assert own + lost * vocabulary.unknown_score == pytest.approx(best[-1])


def test_words_are_remembered_within_bounds(monkeypatch):
    from cartwright.llm import sentence_pieces

    monkeypatch.setattr(sentence_pieces, "WORDS_REMEMBERED", 20)
    vocabulary, library = PieceModel(proto()), sentencepiece.SentencePieceProcessor(model_proto=proto())
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(9)) for _ in range(3)]
        assert [numbers(r) for r in vocabulary.encode(texts)] == library.encode(texts)
        assert len(vocabulary.words) <= 20


def test_odd_documents(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_proto=proto())
    rows = decode_pieces(encode_pieces(odd_docs)).collect()
    want = [(r.doc_id, len(library.encode(r.text or "")), r.text or "") for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_ids, r.text) for r in rows), key=repr) == sorted(want, key=repr)
    assert decode_pieces(encode_pieces(no_docs)).count() == 0
