"""Methods against plain versions that enumerate what the operators compute in bulk."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, fingerprints, graph, langid, quality, substrings, toxicity

from .test_llm import none, odd, prose, table  # noqa: F401

M64 = (1 << 64) - 1


# language identification


def plain_buckets(text):
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = []
    for n in langid.SUBWORDS:
        for i in range(len(letters) - n + 1):
            w = letters[i : i + n]
            if w == "  " if n == 2 else " " in w[1:-1]:
                continue
            h = n
            for c in w:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
            h ^= h >> 29
            out.append((h * 0xBF58476D1CE4E5B9 & M64) >> (64 - langid.BITS))
    return sorted(out)


def test_subwords_and_means():
    model = langid.train(["ka to mi ru " * 9, "schu gen tz ber " * 9], ["a", "b"], [False, False])
    for text in ["a", "Ab c", "ka-to  mi", "é ß ñ. 中文 字 𝒳y", "x1y22z"]:
        rows = plain_buckets(text)
        assert sorted(langid.buckets(langid.letters_of(text)).tolist()) == rows
        mean = sum((model.table[r].astype(np.float64) for r in rows), np.zeros(2)) / len(rows)
        assert model.logits(text) == pytest.approx(mean + model.bias)
        z = (mean + model.bias) / model.temperature
        lang, score = model.predict(text)
        assert lang == "ab"[int(z.argmax())] and score == pytest.approx(1 / (1 + math.exp(z.min() - z.max())))


def test_many_languages(spark):
    rows = [(i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{k} " * 12, f"l{k:02}", "s", 1) for i, k in enumerate(k for k in range(70) for _ in range(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs, F.lit(True), F.lit(False))
    assert len(model.languages) == 70
    tied = langid.identify(docs, model).groupBy("text").agg(F.countDistinct("lang_pred", "score").alias("n"))
    assert {r.n for r in tied.collect()} == {1}  # equal texts have equal results


# toxicity


def plain_restore(token, model):
    """The best of all paths through the lattice."""
    best = None
    choices = []
    for i, sign in enumerate(token):
        own = [(letter, code, cost) for letter, code, cost in toxicity.options_of(sign)]
        if i and sign == token[i - 1] and sign != " ":
            own.append((None, 0, toxicity.REPEATED))
        choices.append(own)
    for path in itertools.product(*choices):
        a = b = 0
        cost, word, last = 0.0, "", ""
        for sign, (letter, code, extra) in zip(token, path):
            if letter is None and last != sign:  # a repetition needs a letter written by the same sign before it
                break
            cost += extra
            if letter:
                cost += float(model.costs[a, b, code])
                a, b, word, last = b, code, word + letter, sign
        else:
            cost += float(model.costs[a, b, 0])
            if best is None or cost < best[0] - 1e-9:
                best = (cost, word)
    return best[1]


def test_viterbi_is_the_best_path():
    rng = random.Random(5)
    text = " ".join(["stupid idiot moron list told dots привет мир"] * 30 + [prose(rng, 50)])
    model = toxicity.CharacterModel(toxicity.trigram_counts(text))
    for token in ["1d10t", "$tup1d", "m.o.r.0n", "iid11ot", "s t u p", "a i d", "пр1вет", "при-вет", "τ0ld", "lii5t", "i--d", "111"]:
        assert toxicity.restore(token, model) == plain_restore(token, model), token


def test_letters_of_all_scripts_stay():
    model = toxicity.CharacterModel(toxicity.trigram_counts("stupid idiot привет мир " * 50))
    assert toxicity.words_behind("привет", model) == ["привет"]
    assert toxicity.words_behind("при-вет", model) == ["привет"] and toxicity.words_behind("пр.и.в.ет!", model) == ["привет"]
    assert toxicity.words_behind("stupіd", model) == ["stupid"]  # the i is Cyrillic
    assert toxicity.words_behind("!!!", model) == [] and toxicity.words_behind("", model) == []
    long = toxicity.restore("ab1" * 70_000, model)
    assert 100_000 < len(long) <= 210_000


def test_blanks_in_words(spark):
    rng = random.Random(9)
    clean = [prose(rng, 40) for _ in range(120)]
    toxic = [" ".join(rng.sample([*prose(rng, 30).split(), *rng.sample(["idiot", "stupid", "moron"], 2)], 32)) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, clean + toxic), labels)
    base = prose(random.Random(77), 15)
    for sign in ("a s t u p i d", "s t u p i d i d i o t", "y m o r o n", "stu pid"):
        assert model.score(f"{base} {sign} {base}") >= 0.7, sign
    assert model.score(f"{base} a b c d e {base}") < 0.5
    assert model.score(None) == model.score("") < 0.7


# fingerprints


def plain_names(text, levels):
    """Phrase names of each level, by loops over one text."""
    mix = lambda x: int(fingerprints.mixed(np.array([x & M64], dtype=np.uint64))[0])
    symbols, out = [ord(c) for c in text], []
    for _ in range(levels):
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        now = []
        for s, n in runs:
            s = mix((s * int(fingerprints.MIX) + n)) if n > 1 else s
            now.append(s)
        now = [s + (i > 0 and s == now[i - 1]) for i, s in enumerate(now)]
        labels = list(now)
        for _ in range(fingerprints.ROUNDS):
            before = [labels[i - 1] if i else labels[0] ^ 1 for i in range(len(labels))]
            fresh = []
            for x, y in zip(labels, before):
                bit = (x ^ y) & -(x ^ y)
                fresh.append(2 * (bit.bit_length() - 1) + (x & bit != 0))
            labels = fresh
        begins = [i == 0 or (i < len(labels) - 1 and labels[i - 1] < labels[i] > labels[i + 1]) for i in range(len(labels))]
        starts = [i for i, b in enumerate(begins) if b] + [len(now)]
        symbols = []
        for a, b in zip(starts, starts[1:]):
            name = 0x51ED270B
            for s in now[a:b]:
                name = (name * int(fingerprints.MIX) + s) & M64
                name ^= name >> 32
            symbols.append(mix(name))
        out.append(list(symbols))
    return out


def test_sketches_equal_plain_ones():
    rng = random.Random(14)
    texts = ["", "a", "ab", "aaaa bbbb", "é ß 中文 𝒳", prose(rng, 3), prose(rng, 40), "x" * 500, prose(rng, 200)]
    for text, sketch in zip(texts, fingerprints.sketches(texts)):
        slots = [None] * fingerprints.SLOTS
        for level, names in enumerate(plain_names(text, max(fingerprints.LEVELS)), 1):
            for name in names if level in fingerprints.LEVELS and text else ():
                h = int(fingerprints.mixed(np.array([(name * int(fingerprints.MIX) + level) & M64], dtype=np.uint64))[0])
                at = h % fingerprints.SLOTS
                slots[at] = h >> 7 if slots[at] is None else min(slots[at], h >> 7)
        assert sketch == " ".join("-" if s is None else f"{s & 0xFFFF:x}" for s in slots)


def test_likeness_has_no_steps():
    """A text and itself less its last characters stay alike at every length from some 100 characters on."""
    rng = random.Random(15)
    for words in range(24, 80, 4):
        likes = []
        for _ in range(12):
            text = prose(rng, words)
            a, b = fingerprints.sketches([text, text[:-4]])
            likes.append(fingerprints.likeness(a, b))
        assert min(likes) > 0.5 and sum(likes) / len(likes) > 0.75


def test_stretches(spark):
    bounds = sorted(random.Random(2).sample(range(1000), 57))
    df = spark.range(1000).select("id", fingerprints.bounds_up_to(F.col("id"), bounds).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: sum(b <= i for b in bounds) for i in range(1000)}


# substring deduplication


def test_removed_is_what_repeats(spark):
    """All words in windows of 60 words that a lesser document has are removed, and all that is removed is in a lesser document."""
    rng = random.Random(41)
    passages = [prose(rng, n) for n in (60, 75, 90, 140, 300)]
    texts = []
    for _ in range(40):
        parts = [x for p in rng.sample(passages, rng.randint(0, 2)) for x in (prose(rng, rng.randint(0, 40)), p)]
        texts.append(" ".join(filter(None, [*parts, prose(rng, rng.randint(5, 40))])))
    texts[7] = texts[3]
    found = {r.doc_id: r for r in substrings.deduplicate(table(spark, texts)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[k : k + 60]) for k in range(len(words) - 59)]
        covered = {k + j for k, w in enumerate(windows) if w in seen for j in range(60)}
        gone, at = set(), 0
        starts = [at := text.index(w, at if not n else at + len(words[n - 1])) for n, w in enumerate(words)]
        for s in found[i].removed_spans or ():
            gone.update(k for k, a in enumerate(starts) if s["start"] <= a < s["end"])
            assert any(text[s["start"] : s["end"]].strip() in other for other in texts[:i]), i
        # a run goes on as far as one lesser document does; a word that chance has in another one too may stay beside it
        assert len(covered - gone) <= 2, (i, sorted(covered - gone)[:5])
        seen.update(windows)


# byte-pair encoding


def plain_merge(vocabulary, word):
    parts = [vocabulary.letters[b] for b in word]
    parts[-1] += vocabulary.end
    while True:
        ranked = [(vocabulary.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.ranks]
        if not ranked:
            return [vocabulary.ids[p] for p in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_heap_merges_like_the_plain_way():
    vocabulary = bpe.vocabulary_at(bpe.tokenizer_path())
    rng = random.Random(6)
    for n in (1, 2, 3, 10, 49, 200, 600):
        for letters in ("ab", "thein", "éß中a", "x"):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert vocabulary.merge(word) == plain_merge(vocabulary, word)


def test_a_word_of_a_megabyte():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path()
    text = "".join(random.Random(8).choice("abcdefgh") for _ in range(1_000_000))
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoder = bpe.encoder_for(path, bpe.lexicon_for(path), bpe.AsIds())
    assert [i for p in next(iter(encoder.batches([text]))) for i in p] == library.encode(text, add_special_tokens=False).ids


# quality


def test_cascade_stops_at_the_first_rule(spark):
    """A later rule that fails when evaluated is not evaluated where an earlier one rejects."""
    df = spark.createDataFrame([("no",), ("yes",)], "text string")
    rules = {"first": F.col("text") == "no", "second": F.when(F.col("text") == "no", F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)).cast("boolean")}
    assert [r[0] for r in df.select(quality.cascade(rules, ["first", "second"])).orderBy("text").collect()] == ["first", None]
    order = quality.measured_order(df, {"none": F.lit(False), "all": F.lit(True)})
    assert order == ["all", "none"]


def test_sampled_letters_share_one_buffer():
    texts = ["Ab c", "", "x" * 70_000, "ß\U0001d4d0 9"]
    found = langid.coded(iter(texts))
    assert [x.tolist() for x in found] == [langid.letters_of(t).tolist() for t in texts]
    assert len({id(x.base) for x in found}) == 1 and found[0].base is not None


def test_a_round_of_components_joins_once_a_plan(spark, monkeypatch):
    """The driver holds and redraws each plan, so no step's plan has a star inside another; edges that are stars already take one round, none take none."""
    plans, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or store(df, label))
    cases = [([(9, 8), (8, 7), (7, 3), (5, 4), (6, 6)], {9: 3, 8: 3, 7: 3, 3: 3, 5: 4, 4: 4}, None), ([(5, 1), (1, 4), (3, 2)], {5: 1, 4: 1, 1: 1, 3: 2, 2: 2}, 3), ([], {}, 1)]
    for edges, expected, steps in cases:
        plans.clear()
        found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len(expected) and {r.node: r.component for r in found} == expected
        assert max(plans) <= 1 and steps in (None, len(plans))
