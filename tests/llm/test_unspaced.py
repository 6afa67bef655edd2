"""Operators 3 and 7 on what has no blanks, or signs in the place of blanks."""

import random

import numpy as np
import pytest

from tidebar.llm import substrings, toxicity

from .test_llm import prose


def chunk_texts(text):
    raw = text.encode()
    ends = [0, *substrings.chunk_ends(np.frombuffer(raw, dtype=np.uint8)).tolist()]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def chinese(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))


@pytest.mark.parametrize("front", ["x", "中", "ab c "])
def test_an_insertion_moves_few_chunks(front):
    text = chinese(random.Random(1), 6000)
    before, after = chunk_texts(text), chunk_texts(front + text)
    assert b"".join(before) == text.encode() and all(len(c) <= substrings.LONGEST for c in before)
    assert len(set(before) & set(after)) >= 0.95 * len(before) > 100
    for c in before:
        c.decode()  # cut between characters


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in substrings.deduplicate(docs).collect()}


@pytest.mark.parametrize("n", [1500, 150])
def test_passages_without_blanks(spark, n):
    rng = random.Random(n)
    found = 0
    for _ in range(3):
        passage = chinese(rng, n)
        texts = [chinese(rng, rng.randint(200, 400)) + passage + chinese(rng, rng.randint(200, 400)) for _ in range(12)]
        rows = removed(spark, texts)
        assert rows[0].text == texts[0]
        for i in range(1, 12):
            gone = sum(s["end"] - s["start"] for s in rows[i].removed_spans)
            assert gone <= n and len(rows[i].text) + gone == len(texts[i])
            found += gone == n
    assert found >= 0.9 * 33


def test_passages_between_words_stay_whole_words(spark):
    rng = random.Random(2)
    shared = prose(rng, 120)
    rows = removed(spark, [prose(rng, 60) + " " + shared + " " + prose(rng, 60) for _ in range(4)])
    for i in (1, 2, 3):
        assert shared not in rows[i].text and len(rows[i].text.split()) in (120, 121)


@pytest.fixture(scope="module")
def characters():
    rng = random.Random(3)
    words = ["moron", "idiot", "wonderful", "stupid", "yesterday", "weather", "garden", "reading"]
    text = " ".join(rng.choice(words) for _ in range(5000))
    return toxicity.CharacterModel(toxicity.trigram_counts(text))


@pytest.mark.parametrize("token, words", [
    ("moron...yesterday", {"moron", "yesterday"}), ("idiot---wonderful", {"idiot", "wonderful"}), ("wonderful/stupid", {"wonderful", "stupid"}), ("m0ron!!!w3ather", {"moron", "weather"}),
    ("st-upid", {"stupid"}), ("s.t.u.p.i.d", {"stupid"}), ("m...o...r...o...n", {"moron"}), ("idiot,moron;garden", {"idiot", "moron", "garden"}), ("-" * 5000 + "idiot" + "=" * 5000, {"idiot"}),
])
def test_every_part_is_decoded(characters, token, words):
    assert words <= set(toxicity.words_behind(token, characters))


def test_three_letters_out_of_a_run():
    model = toxicity.Model(toxicity.trigram_counts("ass the " * 500), {"ass": 5.0}, -2.0, 100.0)
    assert model.score("you a s s you") > 0.9 > model.score("you a s k you")


def test_no_word_is_left_out_for_length():
    model = toxicity.Model(toxicity.trigram_counts("moron the " * 500), {"moron": 3.0}, -2.0, 10.0)
    scores = [model.score("moron " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))) for n in (5, 40, 160, 600)]
    plain = model.score("nothing")
    assert scores == sorted(scores, reverse=True) and scores[-1] > plain
