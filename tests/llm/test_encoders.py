"""The three operators of round 3: against the sentencepiece library, a plain resampling and a plain clustering."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import bpe, centroids, pieces, resampling

PATH = pieces.model_path()
MODEL = pieces.model_at(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SYLLABLES = ["a", "b", "the", " ", "  ", "é", "中", "文", "\n", "▁", "𝔘", "ing", "er", "0", "1", "aa", "\x00", "</s>", "<s>", "<0x41>", "е", "и", "ка", "한", "국", "�", " ", "Ωmega"]


def encoded(text):
    return [i for unit in MODEL.units(text) for i in MODEL.encode_unit(unit)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SYLLABLES), max_size=40).map("".join) | st.text(max_size=40))
def test_pieces_as_in_the_library(text):
    ids = encoded(text)
    assert ids == LIBRARY.encode(text) and MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 260), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["ab" * 50_000, "a" * 50_001, "中文字符测试" * 5000, " " * 1000 + "x" + " " * 33, "the" * 999 + "\x01" + "der" * 999, "​" * 500])
def test_long_units(text):
    assert encoded(text) == LIBRARY.encode(text)


def test_backtracking_is_needed():
    """Somewhere the longest piece is not the right one: greedy longest matches differ from the library."""
    greedy_differs = 0
    rng = random.Random(5)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("etaoinshr") for _ in range(12))
        at, greedy = 0, []
        while at < len(word):
            n = max(n for n in range(1, 17) if word[at : at + n] in MODEL.ids)
            greedy.append(MODEL.ids[word[at : at + n]])
            at += len(word[at : at + n])
        assert MODEL.encode_unit(word) == LIBRARY.encode(word[1:])
        greedy_differs += greedy != MODEL.encode_unit(word)
    assert greedy_differs > 50


def test_memo_of_two_generations(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 3)
    memo = pieces.Memo(MODEL, tuple)
    for text in ["one two three four five six", "one two", "six one two"]:
        assert [i for unit in memo.values(text) for i in unit] == LIBRARY.encode(text)
    assert len(memo) <= 3 and len(memo.older) <= 3


def test_ids_and_texts_as_columns(spark):
    rows = [(1, "Hello  world\n中", "x"), (2, "", "x"), (3, None, "x")]
    df = pieces.with_ids(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), PATH)
    found = {r.doc_id: r for r in pieces.with_text(df, PATH).collect()}
    assert found[1].ids == LIBRARY.encode("Hello  world\n中", add_eos=True) and [found[i].decoded for i in (1, 2, 3)] == ["Hello  world\n中", "", ""]
    digest = {r.doc_id: r for r in pieces.digests(df, PATH).collect()}
    for i in (1, 2, 3):
        assert (digest[i].n_tokens, digest[i].ids_sha256) == (len(found[i].ids), hashlib.sha256(" ".join(map(str, found[i].ids)).encode()).hexdigest())


# resampling


def plain_resampling(docs, bench, percent=10, least=20, seed=2024, longest=1, buckets=10_000):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    code = lambda f: zlib.crc32(f) % buckets
    s = collections.Counter(code(f) for _, t in docs for f in features(t))
    t = collections.Counter(code(f) for _, x in bench for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for key, text in docs:
        own = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[code(f)] for f in own)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


def word_rows(rng, n):
    words = ["der", "the", "Of", "ZEIT", "é", "Ünd", "中文", "x1", "a-b", "it's", *(f"w{i}" for i in range(300))]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 21, 60]))) + rng.choice(["", "\n", "!"])) for i in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_as_in_a_plain_version(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "SLICE_ROWS", 1)  # a slice for each batch
    rng = random.Random(longest)
    docs = word_rows(rng, 400) + [(None, "no id " * 30), (1000, None), (1001, "the " * 5000)]
    bench = word_rows(rng, 20)
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id long, text string"), longest=longest, percent=25)
    assert sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain_resampling(docs, bench, longest=longest, percent=25)


def test_long_texts_are_split_between_words(monkeypatch):
    text = "Alpha beta  gamma-delta é ζ " * 50
    whole = [sorted(w for part in resampling.features_of(text, n) for w in part) for n in (1, 2, 3)]
    monkeypatch.setattr(resampling, "PART_BYTES", 7)
    assert [sorted(w for part in resampling.features_of(text, n) for w in part) for n in (1, 2, 3)] == whole
    assert len(whole[0]) == 300 and len(whole[2]) == 300 + 299 + 298


def test_ranks_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id % 7 as score", "id as doc_id").repartition(9)
    found = sorted(resampling.ranked(df, df.score.desc(), df.doc_id.asc()).collect(), key=lambda r: r.rank)
    assert [(r.score, r.doc_id) for r in found] == sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1])) and [r.rank for r in found] == list(range(1, 1001))


# clustering


def plain_clusters(vectors, k, rounds, size, seed=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors]
    centers = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    own = lambda: [min(range(len(centers)), key=lambda i: (far(v, centers[i]), i)) for _, v in kept]
    for _ in range(rounds):
        found = own()
        for i in range(len(centers)):
            rows = [v for (_, v), c in zip(kept, found) if c == i]
            if rows:
                centers[i] = [sum(col) // len(rows) for col in zip(*rows)]
    return sorted((i, c, far(v, centers[c]), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, v), c in zip(kept, own()))


@pytest.mark.parametrize("scale", [1.0, 1e5, 3e6])  # float64, 64-bit integers, and both beside one another
def test_clusters_as_in_a_plain_version(spark, scale):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(i % 5, 0.4) * scale for _ in range(6)]) for i in range(240)] + [(500 + i, [1.0 * scale] * 6) for i in range(80)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)
    found = centroids.cluster(df, k=9, rounds=4, size=6)
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found.collect()) == plain_clusters(vectors, 9, 4, 6)


def test_distances_beyond_a_long(spark):
    vectors = [(i, [float(i % 3) * 1e15, 2.0**70 if i == 4 else -3.0]) for i in range(12)]
    found = centroids.cluster(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=2, rounds=3, size=2).collect()
    want = {i: (c, d if d < 1 << 63 else None, s) for i, c, d, s in plain_clusters(vectors, 2, 3, 2)}
    assert {r.vec_id: (r.cluster, r.distance, r.centroid_sha256) for r in found} == want and {r.inertia for r in found} == {None}


@pytest.mark.parametrize("top", [1, 2**20, 2**24, 2**29, 2**40, 2**61])
def test_distances_are_exact(top):
    rng = random.Random(top)
    rows, centers = ([[rng.choice([top, -top, top - 1, 0, rng.randrange(-top, top + 1)]) for _ in range(64)] for _ in range(n)] for n in (30, 7))
    found = centroids.squared_distances(np.array(rows, object if top > 2**60 else np.int64), np.array(centers, np.int64))
    assert [[int(d) for d in row] for row in found] == [[sum((a - b) ** 2 for a, b in zip(r, c)) for c in centers] for r in rows]


def test_fewer_vectors_than_clusters(spark):
    found = centroids.cluster(spark.createDataFrame([(1, [0.5, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>"), k=5, size=2).collect()
    assert sorted((r.vec_id, r.distance) for r in found) == [(1, 0), (2, 0)] and len({r.cluster for r in found}) == 2


def test_digests_spell_packed_ids(monkeypatch):
    """Operator 8's memo keeps ids alone, 4 bytes each; a text's decimals and tokens are spelled once, some at a time."""
    path = bpe.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["The cat, sat on 12 mats! <|endoftext|> naïve Σίσυφος", "", "x", "a b c d e f g"]
    encoder = bpe.Encoder(bpe.vocabulary_at(path), bpe.Lexicon(bpe.lexicon_for(path)), bpe.Packed())
    for spelled in (1, 3, 100_000):
        monkeypatch.setattr(bpe, "SPELLED", spelled)
        found = [bpe.digest(b"".join(parts), path) for parts in encoder.batches(texts)]
        for text, (n, ids_sha, decoded_sha) in zip(texts, found):
            ids = library.encode(text, add_special_tokens=False).ids
            told = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
            assert (n, ids_sha, decoded_sha) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in told))
    assert all(isinstance(v, bytes) and len(v) % 4 == 0 for v in encoder.memo.now.values())


BITS = ["the", "Cat,", "naïve", "Σίσυφος", "ΣΑΣ", "éa", "İx", "12.5", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "中文字", "x" * 60, "!?", ".,!", "don't", "q" * 47 + "z.", "𝔘𝔫𝔦"]
GAPS = [" ", "  ", "\n", "\t", "　", "\x1c", "\x1f", "\x85", " ", "​", "᠎"]


def plain_and_packed(texts, sizes=(1, 50, 4_000_000), entries=600_000, learned=50_000):
    """The ids of a column by the packed encoder, in parts of these sizes and twice over, equal those of the library."""
    path = bpe.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in sizes:
        encoder = bpe.PackedEncoder(bpe.vocabulary_at(path), bpe.Lexicon(bpe.lexicon_for(path)))
        encoder.memo.entries, encoder.LEARNED = entries, learned
        for _ in range(2):
            column = pa.array(["cut off", *texts, None], pa.string()).slice(1, len(texts))
            found = [np.frombuffer(ids[a:b], "<u4").tolist() for ids, ends in encoder.columns(column, size) for a, b in zip(ends, ends[1:])]
            assert found == want
    return encoder


@pytest.mark.parametrize("gaps", [GAPS, [g for g in GAPS if g not in "\x1c\x1f"]])
def test_packed_columns_as_in_the_library(gaps):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) + rng.choice(gaps) * rng.randint(0, 2) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    texts += [None, "", " ", " lead", "trail ", " ".join(f"a{c}b" for c in map(chr, range(0x3000)) if unicodedata.category(c) != "Cn"), None]
    plain_and_packed(texts)
    plain_and_packed(texts, sizes=(50,), entries=8, learned=3)
    plain_and_packed([], sizes=(1,))
    plain_and_packed([None], sizes=(1,))


def test_white_space_of_arrow_is_that_of_python():
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert bpe.pc.utf8_split_whitespace(pa.array(texts)).to_pylist() == [t.split() for t in texts]


def test_packed_memo_is_small_and_bounded():
    """An entry, key and ids, takes less than 80 bytes; of strings and bytes in a dict it takes about 200."""
    memo, before = bpe.PackedMemo(20_000), pa.total_allocated_bytes()
    make = lambda keys: bpe.packed(np.arange(3 * len(keys)), np.full(len(keys), 3))
    for at in range(0, 90_000, 5000):
        wanted = pa.array([f"piece{i}" for i in range(at, at + 5000)])
        assert len(memo.values(wanted, make)) == 5000
        assert len(memo.now[0]) <= 15_000 and len(memo.before[0]) <= 15_000
    del wanted
    assert len(memo.now[0]) + len(memo.before[0]) >= 10_000 and pa.total_allocated_bytes() - before < 80 * (len(memo.now[0]) + len(memo.before[0]))


def test_strings_are_made_of_new_pieces_alone(monkeypatch):
    """Texts are cut and joined as columns: a piece becomes a string once, not as often as it is there."""
    path = bpe.tokenizer_path()
    monkeypatch.setattr(bpe.Encoder, "batches", None)
    monkeypatch.setattr(bpe.Encoder, "pieces", None)
    encoder, seen = bpe.PackedEncoder(bpe.vocabulary_at(path), bpe.Lexicon(bpe.lexicon_for(path))), []
    monkeypatch.setattr(encoder, "_learned", lambda pieces, f=encoder._learned: seen.extend(pieces) or f(pieces))
    for _ in range(3):
        list(encoder.columns(pa.array(["one two two " * 500, None, "two three"])))
    assert sorted(seen) == ["", "one", "three", "two"]


def test_frequent_words_are_counted_as_columns(spark, monkeypatch):
    """Equal to a plain count, whatever is held at a time; no task keeps pieces in a dict."""
    path = bpe.tokenizer_path()
    vocabulary = bpe.vocabulary_at(path)
    texts = ["The the cat, CAT 12 a1", None, "", " naïve\x1ccat <|endoftext|> don't ", "the <| x", "ΣΑΣ cat."] * 3
    plain: collections.Counter = collections.Counter()
    for t in texts:
        plain.update(w.encode() for p in (t or "").split() if "<|" not in p for w in vocabulary.words(p))
    for held in (2, 250_000):
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", held)
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
        assert sorted(bpe.frequent_words(df, path, limit=1000)) == sorted(w for w, n in plain.items() if n > 1)
    found = {}
    for batch in bpe.word_counts(vocabulary, ["The", "the,", "<|x", "12."], [1, 2, 4, 8]):
        for row in batch.to_pylist():
            found[row["word"]] = found.get(row["word"], 0) + row["n"]
    assert found == {b"the": 3, b",": 2, **{w.encode(): 8 * n for w, n in collections.Counter(vocabulary.words("12.")).items()}}
