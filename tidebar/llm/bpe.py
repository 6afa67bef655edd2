"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent words, counted over the whole corpus and joined by the vocabulary's own whole words, are compiled with their id lists into one
automaton whose equal suffixes are shared (incremental construction from sorted words). Each edge carries how many words precede it, so that
a walk yields the word's number, and the number its ids. The automaton is one flat file of integers: it reaches executors as a broadcast of
bounded size and is memory-mapped there. Words that it lacks are merged exactly by rank, many at once.

The text is cut at white space first, which no token of this vocabulary crosses; a bounded memo keeps the ids of pieces already seen by a worker.
Its entries are of two generations, so that pieces which come back now and then outlast it when it is full.

Edge cases: a null or empty text has no ids; the special tokens' strings in a text become their ids, as in the library; repeated rows encode alike.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import json
import os
import re
import struct
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import most_frequent, slices, stored, table

#: Most words of the lexicon that come from the corpus, and entries of a memo before it is emptied.
FREQUENT_WORDS = 40_000
MEMO_ENTRIES = 250_000
#: Ids that are spelled at a time.
SPELLED = 100_000

#: Characters that str.split() takes for white space and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[^\\S\x1c-\x1f]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable in Latin-1, else the next free one from 256."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = itertools.count(256)
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and the splitting rules of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in itertools.chain(self.ids.items(), self.special.items())}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.end = model["end_of_word_suffix"]
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}

    def normalize(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        return "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()  # a final sigma is lowered like any other

    def lowered(self, pieces: list[str]) -> tuple[list[str], list[str]]:
        """Pieces in lower case, all at once, and the same without the signs at their ends; both empty where a piece among them is no plain case."""
        joined = "\n".join(pieces)
        if "Σ" in joined or not unicodedata.is_normalized("NFC", joined):
            return [""] * len(pieces), [""] * len(pieces)
        found = joined.lower().split("\n") if pieces else []
        return found, [p.rstrip(".,!") for p in found]

    def words(self, piece: str) -> list[str]:
        """The words of a piece that has neither white space nor special tokens."""
        text = self.normalize(piece)
        core = text.rstrip(".,!")
        if core.isalpha():  # letters are one word, and so are signs after them
            return [core, text[len(core) :]] if len(core) < len(text) else [core]
        return self.word.findall(text)

    def whole_words(self) -> list[bytes]:
        """The words that are single tokens of the vocabulary."""
        found = []
        for token in self.ids:
            if token.endswith(self.end) and len(token) > len(self.end):
                found.append(bytes(map(self.bytes_of.__getitem__, token[: -len(self.end)])))
        return found

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word by exact merging: always the pair of the lowest rank, the leftmost first. A heap holds the pairs, so long words cost n log n."""
        parts = [self.letters[b] for b in word]
        parts[-1] += self.end
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j == n or ranks.get((parts[i], parts[j])) != rank:  # one of the two has been merged since
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i))
            if (p := before[i]) >= 0 and (pair := (parts[p], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], p))
        return [self.ids[p] for p in parts if p]


def cut(values, sizes: np.ndarray) -> list:
    """A sequence cut into stretches of these sizes."""
    ends = np.cumsum(sizes).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def flat_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another as an array of bytes, where each starts, and how many bytes it has."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


class Merger:
    """Exact merging of many words at once: rows of token numbers in which the pair of the lowest rank, the leftmost first, becomes one token per step."""

    NONE = (1 << 31) - 1
    LONGEST = 48

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        pairs = [(vocabulary.ids[a], vocabulary.ids[b], r, vocabulary.ids[a + b]) for (a, b), r in vocabulary.ranks.items()]
        known = np.array(pairs, dtype=np.int64).reshape(-1, 4)
        keys = known[:, 0] << 32 | known[:, 1]
        # a table of 2^20 slots, in which each pair stands within a few slots after that of its hash, and none between them is free
        self.keys, self.rank = np.full((1 << 20) + 64, -1, dtype=np.int64), np.full((1 << 20) + 64, self.NONE, dtype=np.int32)
        rest, probes = np.arange(len(keys)), 0
        while len(rest):
            slot = self._slot(keys[rest]) + probes
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            taken = rest[free][first]
            self.keys[slot[free][first]], self.rank[slot[free][first]] = keys[taken], known[taken, 2]
            rest = np.setdiff1d(rest, taken)
            probes += 1
        self.merged = np.zeros(int(known[:, 2].max(initial=0)) + 1, dtype=np.int32)  # the token that the merge of a rank makes
        self.merged[known[:, 2]] = known[:, 3]
        self.first = np.array([vocabulary.ids[c] for c in vocabulary.letters], dtype=np.int32)
        self.last = np.array([vocabulary.ids[c + vocabulary.end] for c in vocabulary.letters], dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where it has none. Only pairs whose slot another one holds look further."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.rank[slot], np.int32(self.NONE))
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slot[more] += 1
            there = self.keys[slot[more]]
            hit = more[there == keys[more]]
            found[hit] = self.rank[slot[hit]]
            more = more[(there != keys[more]) & (there >= 0)]
        return found

    def all(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        for which, ids, sizes in self.groups(words):
            for i, own in zip(which, cut(ids.tolist(), sizes)):
                out[i] = own
        return out

    def groups(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Words of one length at a time: which they are, their ids one word after another, and how many each has."""
        for which, ids, sizes in self.flat_groups(*flat_words(words)):
            yield which.tolist(), ids, sizes

    def flat_groups(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for words that are stretches of one array of bytes."""
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            if length > self.LONGEST:
                merged = [self.vocabulary.merge(data[a : a + length].tobytes()) for a in starts[which].tolist()]
                yield which, np.array([i for ids in merged for i in ids], dtype=np.int32), np.array([len(ids) for ids in merged])
                continue
            own = data[starts[which][:, None] + np.arange(length)]
            rows = self.first[own]
            rows[:, -1] = self.last[own[:, -1]]
            yield which, *self._merged(rows)

    def _merged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Only the two pairs beside a new token are looked up again."""
        n, width = rows.shape
        left, done, live, now = np.full(n, width), np.zeros_like(rows), np.arange(n), rows
        rank = self.pairs(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(n, width - 1)
        while width > 1:
            at = np.arange(len(live))
            best = rank.argmin(axis=1)
            lowest = rank[at, best]
            more = lowest < self.NONE
            if not more.all():
                done[live[~more], :width], left[live[~more]] = now[~more], width
                live, now, rank, best, lowest = live[more], now[more], rank[more], best[more], lowest[more]
                if not len(live):
                    break
                at = np.arange(len(live))
            joined = self.merged[lowest]
            now[at, best] = joined
            columns = np.arange(width)
            now = now[columns != best[:, None] + 1].reshape(len(live), width - 1)
            rank = rank[columns[:-1] != best[:, None]].reshape(len(live), width - 2)
            width -= 1
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < width - 1)
            found = self.pairs(
                np.concatenate([now[before, best[before] - 1], joined[after]]),
                np.concatenate([joined[before], now[after, best[after] + 1]]),
            )
            rank[before, best[before] - 1] = found[: len(before)]
            rank[after, best[after]] = found[len(before) :]
        else:
            done[live, :1], left[live] = now, 1
        return done[np.arange(done.shape[1]) < left[:, None]], left


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The flat automaton of (word, ids) entries with distinct words that are not empty.

    Words come in sorted order; once a word leaves a branch, its states are final and are merged with equal ones from the bottom up.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is final, ((byte, state), ...)), children before parents

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, []]], b""
    for word, _ in entries:
        shared = len(os.path.commonprefix([word, last]))
        while len(path) > shared + 1:
            done = close(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = close(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    close(path[0])
    below, keys, targets, skips, root = [], [], [], [], len(states) - 1
    for number, (final, edges) in enumerate(states):
        seen = int(final)
        for byte, target in edges:
            keys.append(number << 8 | byte)
            targets.append(target)
            skips.append(seen)
            seen += below[target]
        below.append(seen)
    sizes = np.cumsum([0, *(len(ids) for _, ids in entries)])
    finals = [int(final) for final, _ in states]
    flat = [keys, targets, skips, finals, sizes, [i for _, ids in entries for i in ids]]
    longest = max((len(w) for w, _ in entries), default=0)
    return np.concatenate([np.array([root, longest, *map(len, flat)], dtype=np.uint32), *(np.asarray(x, dtype=np.uint32) for x in flat)]).tobytes()


class Lexicon:
    """The automaton, memory-mapped. The file has no name, so nothing stays behind on the machine."""

    def __init__(self, content: bytes):
        with os.fdopen(os.memfd_create("lexicon"), "w+b") if hasattr(os, "memfd_create") else tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            flat = np.memmap(f, dtype=np.uint32, mode="r")
        self.root, self.longest, *lengths = map(int, flat[:8])
        ends = 8 + np.cumsum(lengths)
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = (flat[e - n : e] for e, n in zip(ends.tolist(), lengths))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where the automaton doesn't accept it."""
        return self.flat_numbers(*flat_words(words))

    def flat_numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for words that are stretches of one array of bytes. All words advance by one byte at a time together."""
        state, number = np.full(len(sizes), self.root), np.zeros(len(sizes), dtype=np.int64)
        alive = (sizes > 0) & (sizes <= self.longest)
        for at in range(self.longest if len(self.keys) else 0):
            now = np.flatnonzero(alive & (sizes > at))
            if not len(now):
                break
            key = (state[now] << 8 | data[starts[now] + at]).astype(np.uint32)
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            alive[now[~hit]] = False
            now, edge = now[hit], edge[hit]
            number[now] += self.skips[edge]
            state[now] = self.targets[edge]
        accepted = alive & (self.finals[state] == 1)
        return np.where(accepted, number, -1)

    def outputs(self, numbers: np.ndarray) -> list[list[int]]:
        """Ids of the words of these numbers."""
        ids, sizes = self.flat_outputs(numbers)
        return cut(ids.tolist(), sizes)

    def flat_outputs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same ids one word after another, and how many each word has."""
        starts, ends = self.offsets[numbers].astype(np.int64), self.offsets[numbers + 1].astype(np.int64)
        sizes = ends - starts
        return self.ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


@functools.lru_cache(maxsize=4)
def merger_of(vocabulary: Vocabulary) -> Merger:
    return Merger(vocabulary)


class AsIds:
    """Renders ids as they are. A renderer makes a value of a word's ids, and one value of those of a piece; equal renderers are interchangeable.

    entries: how many values a memo holds, besides those that are asked for at a time.
    """

    entries = MEMO_ENTRIES

    def word(self, ids: list[int]):
        return tuple(ids)

    def words(self, ids: np.ndarray, sizes: np.ndarray) -> list:
        """The values of many words, whose ids stand one word after another."""
        return list(map(self.word, cut(ids.tolist(), sizes)))

    def joined(self, values: list):
        return tuple(i for v in values for i in v)

    def __eq__(self, other):
        return type(self) is type(other) and self.__dict__ == other.__dict__

    def __hash__(self):
        return hash(type(self))


class Memo:
    """Values by key in two generations of half its entries: a full one is kept for as long as the next one takes to fill, and keys wanted meanwhile move on."""

    def __init__(self, entries: int):
        self.entries = entries
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """What neither has and is to be put into `now`, which holds the rest of what is wanted until it is asked again."""
        if len(self.now) > self.entries // 2:
            self.now, self.before = {}, self.now
        left, before = wanted.difference(self.now), self.before
        again = [k for k in left if k in before]
        self.now.update(zip(again, map(before.__getitem__, again)))
        return left.difference(again)


class Encoder:
    """Encodes texts with a vocabulary and a lexicon; keeps bounded memos of words and pieces, as the renderer makes them."""

    #: Pieces that are put into the memo at a time, which bounds what that takes meanwhile.
    LEARNED = 50_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, render: AsIds):
        self.vocabulary, self.lexicon, self.render, self.merger = vocabulary, lexicon, render, merger_of(vocabulary)
        self.memo, self.known = Memo(render.entries), Memo(render.entries // 4)

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        return [p for p in SPACES.split(text) if p] if ODD_SPACE.search(text) else text.split()

    def split(self, piece: str) -> list[str | int]:
        """A piece's words, and the ids of special tokens."""
        if "<|" not in piece:
            return self.vocabulary.words(piece)
        found: list[str | int] = []
        for p in filter(None, self.vocabulary.specials.split(piece)):
            if p in self.vocabulary.special:
                found.append(self.vocabulary.special[p])
            else:
                found += self.vocabulary.words(p)
        return found

    def learn(self, pieces: Iterable[str]) -> None:
        """Put pieces into the memo: words by the automaton, the rest by merging. Letters with a full stop or the like after them are the plain case."""
        gc.disable()  # many small objects that live on: each pass over them would find nothing
        try:
            waiting = iter(pieces)
            while part := list(itertools.islice(waiting, self.LEARNED)):
                self._learn(part)
        finally:
            gc.enable()

    def _learn(self, pieces: list[str]) -> None:
        lowered, cores = self.vocabulary.lowered(pieces)
        two: list[tuple[str, str, str]] = []
        other: list[tuple[str, list]] = []
        one: dict[str, str] = {}
        for piece, low, core in zip(pieces, lowered, cores):
            if core.isalpha():
                if len(core) == len(low):
                    one[piece] = core
                else:
                    two.append((piece, core, low[len(core) :]))
            else:
                other.append((piece, self.split(piece)))
        wanted = set(one.values())
        wanted.update(c for _, c, _ in two)
        wanted.update(t for _, _, t in two)
        wanted.update(w for _, ws in other for w in ws if isinstance(w, str))
        self._know(list(self.known.missing(wanted)))
        memo, known, render = self.memo.now, self.known.now, self.render
        memo.update(zip(one, map(known.__getitem__, one.values())))
        memo.update((p, render.joined([known[c], known[t]])) for p, c, t in two)
        for piece, ws in other:
            memo[piece] = render.joined([known[w] if isinstance(w, str) else render.word([w]) for w in ws])

    def _know(self, words: list[str]) -> None:
        if not words:
            return
        fresh = [w.encode() for w in words]
        numbers = self.lexicon.numbers(fresh)
        render, known = self.render.words, self.known.now
        accepted = np.flatnonzero(numbers >= 0)
        known.update(zip([words[i] for i in accepted.tolist()], render(*self.lexicon.flat_outputs(numbers[accepted]))))
        rest = np.flatnonzero(numbers < 0).tolist()
        for which, ids, sizes in self.merger.groups([fresh[i] for i in rest]):
            known.update(zip([words[rest[i]] for i in which], render(ids, sizes)))

    def batches(self, texts: list[str | None], chars: int = 4_000_000) -> Iterator[list]:
        """For each text the values of its pieces; so many characters are cut into pieces at a time."""
        at = 0
        while at < len(texts):
            texts_pieces, size = [], 0
            while at < len(texts) and (not texts_pieces or size + len(texts[at] or "") <= chars):
                size += len(texts[at] or "")
                texts_pieces.append(self.pieces(texts[at]))
                at += 1
            missing = self.memo.missing(set().union(*texts_pieces))
            if missing:
                self.learn(missing)
            value = self.memo.now.__getitem__
            for pieces in texts_pieces:
                yield list(map(value, pieces))


def packed(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Stretches of ids as binary values, four bytes an id."""
    ends = np.cumsum(np.concatenate([[0], sizes]), dtype=np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])


def flat_values(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binary values, and the offset of each and of the end."""
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), ends.astype(np.int64)


class PackedMemo:
    """Packed ids by piece in two generations, as in Memo, but in Arrow arrays: some thirty bytes an entry instead of some two hundred."""

    def __init__(self, entries: int):
        self.entries = entries
        self.now = self.before = (pa.array([], pa.string()), pa.array([], pa.large_binary()))

    def values(self, wanted: pa.StringArray, learn) -> pa.LargeBinaryArray:
        """The values of distinct pieces; learn makes those that neither generation has."""
        (keys, values), (old_keys, old_values) = self.now, self.before
        found = pc.index_in(wanted, value_set=pa.concat_arrays([keys, old_keys]))
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(keys) + len(old_keys) + np.arange(new.sum())
        out = pa.concat_arrays([values, old_values, learn(wanted.filter(pa.array(new)))]).take(pa.array(at))
        if len(keys) > self.entries // 2:
            self.before, self.now = self.now, (wanted, out)
        else:
            joins = pa.array(at >= len(keys))
            self.now = pa.concat_arrays([keys, wanted.filter(joins)]), pa.concat_arrays([values, out.filter(joins)])
        return out


class PackedEncoder(Encoder):
    """Encodes columns of texts to packed ids. Texts are cut, told apart and joined as Arrow arrays; only pieces that the memo lacks become strings."""

    entries = 600_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, render: AsIds | None = None):
        super().__init__(vocabulary, lexicon, render or Packed())
        self.memo = PackedMemo(self.entries)

    def columns(self, texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[memoryview, list[int]]]:
        """The packed ids of some texts one after another, and the offset of each and of the end; so many bytes of text are cut into pieces at a time."""
        sizes, at = pc.binary_length(texts).fill_null(0).to_pylist(), 0
        while at < len(texts):
            first, total = at, sizes[at]
            at += 1
            while at < len(texts) and total + sizes[at] <= size:
                total += sizes[at]
                at += 1
            yield self._column(texts.slice(first, at - first))

    def _column(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        lists = cut_at_spaces(texts)
        coded = lists.flatten().dictionary_encode()
        ids, offsets = flat_values(self.memo.values(coded.dictionary.cast(pa.string()), self.learned).take(coded.indices))
        ends = np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_pylist()])
        return memoryview(ids), offsets[ends].tolist()

    def learned(self, pieces: pa.StringArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct pieces."""
        parts = [self._learned(pieces.slice(at, self.LEARNED).to_numpy(zero_copy_only=False).tolist()) for at in range(0, len(pieces), self.LEARNED)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())

    def _learned(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """Words, each with the number of its piece: letters first, then the signs after them, then those of other pieces, where None stands for a special token."""
        lowered, cores = self.vocabulary.lowered(pieces)
        plain = np.fromiter(map(str.isalpha, cores), dtype=bool, count=len(pieces))
        whole = np.flatnonzero(plain).tolist()
        signed = [i for i in whole if len(cores[i]) < len(lowered[i])]
        words: list[str | None] = [cores[i] for i in whole]
        words += [lowered[i][len(cores[i]) :] for i in signed]
        piece, special = [*whole, *signed], []
        for i in np.flatnonzero(~plain).tolist():
            for w in self.split(pieces[i]):
                if not isinstance(w, str):
                    special.append(w)
                    w = None
                words.append(w)
                piece.append(i)
        coded = pa.array(words, pa.string()).dictionary_encode()
        known = self._words(coded.dictionary)
        code = coded.indices.fill_null(0).to_numpy().astype(np.int64)
        if special:
            code[coded.indices.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(special))
            known = pa.concat_arrays([known, packed(np.array(special), np.ones(len(special), dtype=np.int64))])
        numbers = np.array(piece, dtype=np.int64)
        joined = known.take(pa.array(code[np.argsort(numbers, kind="stable")]))
        _, offsets = flat_values(joined)
        ends = offsets[np.cumsum(np.concatenate([[0], np.bincount(numbers, minlength=len(pieces))]))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), joined.buffers()[2]])

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct words: by the automaton, the rest by merging."""
        data, ends = flat_values(words)
        starts, sizes = ends[:-1], np.diff(ends)
        numbers = self.lexicon.flat_numbers(data, starts, sizes)
        accepted, rest = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        order, parts = [accepted], [packed(*self.lexicon.flat_outputs(numbers[accepted]))]
        for which, ids, own in self.merger.flat_groups(data, starts[rest], sizes[rest]):
            order.append(rest[which])
            parts.append(packed(ids, own))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def cut_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Each text's pieces, some of them empty. Arrow's white space is that of str.split(), so texts with one that the tokenizer doesn't take for such are cut in Python."""
    if pc.any(pc.match_substring_regex(texts, ODD_SPACE.pattern)).as_py():
        return pa.array([None if t is None else SPACES.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


@functools.lru_cache(maxsize=4)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


_encoders: dict = {}


def encoder_for(path: str, lexicon: bytes, render, kind: type[Encoder] = Encoder) -> Encoder:
    """The worker's encoder for this tokenizer, lexicon and rendering; it outlives a task, and so does its memo."""
    key = (path, hash(lexicon), render, kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = kind(vocabulary_at(path), Lexicon(lexicon), render)
    return _encoders[key]


def word_counts(vocabulary: Vocabulary, pieces: list[str], times: list[int]) -> list[pa.RecordBatch]:
    """The words of distinct pieces, each with how often it is there if its pieces are there so many times; pieces with special tokens count for nothing."""
    words: list[str] = []
    n: list[int] = []
    for piece, low, core, k in zip(pieces, *vocabulary.lowered(pieces), times):
        if core.isalpha():
            words.append(core)
            n.append(k)
            if len(core) < len(low):
                words.append(low[len(core) :])
                n.append(k)
        elif "<|" not in piece:
            own = vocabulary.words(piece)
            words += own
            n += [k] * len(own)
    found = pa.table({"word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64())}).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": found["word"].cast(pa.binary()), "n": found["n_sum"]}).to_batches()


def frequent_words(df: DataFrame, path: str, text: str = "text", limit: int = FREQUENT_WORDS) -> list[bytes]:
    """The corpus's most frequent words, `limit` at most, counted over all rows: pieces as columns in the tasks, sums in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path)
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = pa.concat_tables(held).group_by("piece").aggregate([("n", "sum")])
            held.clear()
            for part in pieces.to_batches(Encoder.LEARNED):
                yield from word_counts(vocabulary, part["piece"].to_numpy(zero_copy_only=False).tolist(), part["n_sum"].to_pylist())

        for batch in slices(batches, 4000):
            found = pc.utf8_split_whitespace(batch.column(0)).flatten().value_counts()
            held.append(pa.table({"piece": found.field(0).cast(pa.string()), "n": found.field(1)}))
            if sum(map(len, held)) > 2 * MEMO_ENTRIES:
                yield from flush()
        if held:
            yield from flush()

    counts = df.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.where("n > 1"), "words")
    return [bytes(r[0]) for r in most_frequent(counts, limit).select("word").collect()]


def lexicon_for(path: str, frequent: Iterable[bytes] = ()) -> bytes:
    """The compiled lexicon: the vocabulary's whole words and the frequent words, each with its exactly merged ids."""
    vocabulary = vocabulary_at(path)
    return compile_lexicon((w, vocabulary.merge(w)) for w in {*vocabulary.whole_words(), *frequent} if w)


def with_ids(df: DataFrame, path: str, lexicon: bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of its text as array<int>."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    schema = df.drop(out).schema.add(out, T.ArrayType(T.IntegerType()))
    at = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, shared.value, AsIds())
        for batch in slices(batches):
            ids = [[i for p in pieces for i in p] for pieces in encoder.batches(batch.column(at).to_pylist())]
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    return df.mapInArrow(encode, schema)


def with_text(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of an array of ids: the tokens joined by one space, as this tokenizer file has no decoder; ids that it lacks are skipped."""
    schema = df.drop(out).schema.add(out, "string")
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_at(path).tokens
        for batch in batches:
            texts = [" ".join(tokens[i] for i in row or () if i in tokens) for row in batch.column(at).to_pylist()]
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, out])

    return df.mapInArrow(decode, schema)


class Packed(AsIds):
    """Renders ids as little-endian unsigned 32-bit numbers; they are small, so more of them are kept."""

    entries = 300_000

    def word(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        return cut(ids.astype("<u4").tobytes(), sizes * 4)

    def joined(self, values: list[bytes]) -> bytes:
        return b"".join(values)


@functools.lru_cache(maxsize=4)
def spellings(path: str) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """By id: a blank and its decimals; a blank and its token."""
    tokens = vocabulary_at(path).tokens
    ids = range(max(tokens, default=0) + 1)
    return pa.array([b" %d" % i for i in ids], pa.binary()), pa.array([b" " + tokens.get(i, "").encode() for i in ids], pa.binary())


def digest(packed: bytes | memoryview, path: str) -> tuple[int, str, str]:
    """How many ids, and the SHA-256 of their decimals and of their tokens, joined by one space; so many are spelled at a time."""
    ids = np.frombuffer(packed, dtype="<u4")
    sums = hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(ids), SPELLED):
        own = pa.array(ids[at : at + SPELLED])
        for found, spelled in zip(sums, spellings(path)):
            data, ends = flat_values(spelled.take(own))
            found.update(data[int(at == 0) : ends[-1]])
    return len(ids), *(found.hexdigest() for found in sums)


def digests(df: DataFrame, path: str, lexicon: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and the SHA-256 of the ids and of their decoding, from one pass that keeps no ids."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, shared.value, Packed(), PackedEncoder)
        for batch in slices(batches, 4000):
            found = [digest(ids[a:b], path) for ids, ends in encoder.columns(batch.column(1)) for a, b in zip(ends, ends[1:])]
            counts, ids, decoded = ([row[i] for row in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op8. The lexicon holds the corpus's 40,000 most frequent words, counted over all documents, and the vocabulary's whole words."""
    docs = table(spark, sf_dir, "documents")
    path = tokenizer_path()
    return digests(docs, path, lexicon_for(path, frequent_words(docs, path)))


QUERIES = {"op8_transducer_bpe": op8_transducer_bpe}
