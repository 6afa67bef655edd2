"""Toxicity scores by noisy-channel deobfuscation.

The channel: a letter may have been written as a look-alike sign (leetspeak, or a letter of another script), repeated, or set apart by separators or
blanks. A token that shows such signs becomes a lattice: at each position the letters that it can stand for, or nothing. Viterbi decoding finds the
best path under a trigram language model of characters (counted over all documents) and the channel's costs; plain tokens have one path and are
taken as they are. Letters of all scripts stand for themselves; those outside Latin are one class of the model. A separator within a token stands for
nothing or for the end of a word, as the model has it, and so does a blank in a run of single characters, and between two tokens that together are a word
of the lexicon; what comes out as several words is also looked up as one. A run of one sign parts a token into several, each of which is decoded.

Restored words are scored by a lexicon learned from labelled rows: for words and word beginnings the log-odds of the label, less two standard
errors, counted once for each group of near copies. A text's score is the logistic of the prior and its words, the strongest first, each with
eight tenths of the say of the one before; in a text that is longer than clean ones are on average, what each word adds to even odds is divided by how much
longer, as chance finds more in it. No word is left out for the text's length.

Edge cases: null and empty texts score the prior; texts without labels are scored alike; a label other than 0 or 1, or null, is not learned from;
without labels all scores are 0.25; repeated rows score alike; an empty table gives an empty result; a very long token takes time in proportion to its
length; other columns pass through, but one that is named toxicity is replaced.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stored, table

#: Bound of the labelled sample: rows of each label that are expected in it at most.
ROWS_PER_LABEL = 60_000
#: Groups of near copies that must show a word, and the least log-odds of an entry. The lexicon is bounded as the sample is that it comes from.
LEAST_GROUPS, LEAST_WEIGHT = 2, 1.0
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
#: Say of a hit beside that of the next stronger one, so that long texts don't add up weak ones.
LESS = 0.8
#: Letters of a restored word that came out of a run of single characters at least, and of one that came out of two tokens.
LEAST_LETTERS, LEAST_OF_TWO = 3, 4
#: The entry under which a task counts the tokens of clean texts.
TOKENS = " "
#: Words that a worker remembers.
MEMO_ENTRIES = 300_000

#: What look-alike signs stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h",
}
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авеікмнорстухѕјԁɡαεικνορτυχ", "abeikmhopctyxsjdgaeikvoptux"))
SEPARATORS = ".-_*~·•'/\\,:;="
#: Costs of the channel, in nats: a sign for a letter, a sign for nothing, a letter for nothing because it repeats, a separator for nothing.
SIGN, DROPPED, REPEATED, SEPARATED = 0.7, 3.0, 1.0, 0.3

#: The language model's letters: a to z, the small letters of Latin-1, and one class of all others. 0 is the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha())
SIZE, OTHER = 64, 63
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_class = np.where(np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000), OTHER, 0)
for _c, _i in CODE.items():
    _class[ord(_c)] = _i

EDGES = re.compile(r"^[^\w@$!|(<€£*+]+|[^\w@$€£*]+$")
RUN = re.compile(r"([^\w\s])\1{2,}")
PLAIN = re.compile(r"[^\W\d_]+\Z")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LATIN, FOREIGN = re.compile("[a-z]"), re.compile(f"[{''.join(HOMOGLYPHS)}]")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")


def trigram_counts(text: str) -> np.ndarray:
    """How often each three letters in a row occur, as SIZE^3 numbers; an edge of a word is letter 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _class[np.minimum(codes, len(_class) - 1)]
    letters = np.concatenate(([0, 0], letters, [0]))
    grams = (letters[:-2] * SIZE + letters[1:-1]) * SIZE + letters[2:]
    return np.bincount(grams, minlength=SIZE**3)


class CharacterModel:
    """Costs (negative logarithms) of a letter after two letters: trigrams, mixed with bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        unit = (one + 1) / (one.sum() + SIZE)
        pair = (two + 2 * unit) / (two.sum(axis=1, keepdims=True) + 2)
        triple = (three + 2 * pair) / (three.sum(axis=2, keepdims=True) + 2)
        self.costs = (-np.log(triple)).astype(np.float32)


@functools.cache
def options_of(sign: str) -> tuple[tuple[str, int, float], ...]:
    """What a sign can stand for: letter (none, or a blank for the end of a word), its code, and the channel's cost."""
    options = [(sign, CODE.get(sign, OTHER), 0.0)] if sign.isalpha() else []
    options += [(letter, CODE[letter], SIGN) for letter in LOOK_ALIKES.get(sign, HOMOGLYPHS.get(sign, ""))]
    if sign == " ":
        options += [(" ", 0, 0.0), ("", 0, SEPARATED)]
    elif sign in SEPARATORS:
        options += [(" ", 0, SEPARATED), ("", 0, SEPARATED)]
    elif not sign.isalpha():
        options.append(("", 0, DROPPED))
    return tuple(options)


def restore(token: str, model: CharacterModel) -> str:
    """The most likely words behind a token, with blanks between them: Viterbi over the lattice, whose states are the last two letters and the last sign."""
    costs = model.costs
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for sign in token:
        options = options_of(sign)
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (cost, path) in states.items():
            for letter, c, extra in options:
                if letter:
                    key, value, way = (b, c, sign), cost + extra + float(costs[a, b, c]), (path, letter)
                else:
                    key, value, way = (a, b, last), cost + extra, path
                if key not in after or value < after[key][0]:
                    after[key] = (value, way)
            if sign == last and sign != " ":
                key, value = (a, b, last), cost + REPEATED
                if key not in after or value < after[key][0]:
                    after[key] = (value, path)
        states = after
    _, path = min(((cost + float(costs[a, b, 0]), path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def words_behind(token: str, model: CharacterModel) -> list[str]:
    """A token's words in lower case: itself if it is plain, else decoded. Decoration at its edges is no sign of anything.

    A token with blanks is a run of single characters: its words, and the run as one word. So it is with what a run of one sign has cut into single letters.
    """
    if " " in token:
        run = token.lower()
        found = {w for text in (run, run.replace(" ", "")) for w in restore(text, model).split()}
        return sorted(w for w in found if len(w) >= LEAST_LETTERS)
    core = RUN.sub(" ", EDGES.sub("", token.lower())).strip()
    if PLAIN.match(core) and not TRIPLE.search(core) and not (FOREIGN.search(core) and LATIN.search(core)):
        return [core]
    parts = [p for p in core.split() if any(c.isalpha() for c in p)]
    found = set()
    for part in [*parts, "".join(parts)] if len(parts) > 2 and max(map(len, parts)) == 1 else parts:
        words = restore(part, model).split()
        found.update(words, ["".join(words)])
    return sorted(found - {""})


def spaced_words(text: str) -> list[str]:
    """Runs of single characters, with one blank between them."""
    return [" ".join(m.split()) for m in SPACED.findall(text)]


def entries_of(word: str) -> list[str]:
    """What the lexicon may know of a word: itself and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """counts: the character model's trigrams; weights of lexicon entries; prior log-odds of the label; distinct tokens of a clean text on average."""

    counts: np.ndarray
    weights: dict[str, float]
    prior: float
    usual: float = 1.0
    memo: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        #: For the first part of a word that is cut in two, the second parts.
        self.halves: dict[str, set[str]] = {}
        for word in self.weights:
            if len(word) > LEAST_OF_TWO and word.isalpha():
                for i in range(2, len(word) - 1):
                    self.halves.setdefault(word[:i], set()).add(word[i:])

    def weight(self, token: str) -> float:
        if (found := self.memo.get(token)) is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            weights = self.weights
            found = self.memo[token] = max((weights.get(e, 0.0) for w in words_behind(token, self.characters) for e in entries_of(w)), default=0.0)
        return found

    def cut_words(self, tokens: list[str]) -> set[str]:
        """Words of the lexicon that two tokens in a row make, where the model has the blank between them stand for nothing."""
        found = set()
        for i, first in enumerate(tokens[:-1]):
            if (first := first.lower()) in self.halves and (second := EDGES.sub("", tokens[i + 1].lower())) in self.halves[first]:
                if restore(f"{first} {second}", self.characters) == first + second:
                    found.add(first + second)
        return found

    @property
    def characters(self) -> CharacterModel:
        if not hasattr(self, "_characters"):
            self._characters = CharacterModel(self.counts)
        return self._characters

    def score(self, text: str | None) -> float:
        listed = (text or "").split()
        tokens = {*listed, *spaced_words(text or ""), *self.cut_words(listed)}
        less = math.log(max(1.0, len(tokens) / self.usual))
        hits = sorted((math.log1p(math.expm1(w) * math.exp(-less)) for t in tokens if (w := self.weight(t)) > 0), reverse=True)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + sum(w * LESS**i for i, w in enumerate(hits))))))


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of the whole text, and its runs of single characters as one token each."""
    if not text:
        return set()
    return {*text.split(), *spaced_words(text)}


def copy_group(text: str | None, size: int = 5) -> int:
    """A number from 1 that near copies are likely to share: the least hash of any five tokens in a row."""
    tokens = (text or "").split()
    return 1 + min((xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + size])) for i in range(max(1, len(tokens) - size + 1))), default=0) % (1 << 62)


def character_counts(docs: DataFrame, text: str = "text", characters: int = 500_000) -> np.ndarray:
    """Trigram counts over all documents: partial counts in the tasks, sums in Spark; SIZE^3 rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            waiting, size = [], 0
            for t in batch.column(0).to_pylist():
                waiting.append(t or "")
                size += len(waiting[-1])
                if size > characters:
                    total += trigram_counts("\n".join(waiting))
                    waiting, size = [], 0
            total += trigram_counts("\n".join(waiting))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(found.astype(np.int32)), "n": pa.array(total[found])})

    found = docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, dtype=np.int64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def labelled_sample(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label) of a sample: a row is in it if its hash is below its label's share; ROWS_PER_LABEL of each label are expected at most."""
    counts = dict(labels.groupBy(label).count().where(F.col(label).isin(0, 1)).collect())
    drawn = F.pmod(F.xxhash64(F.lit("sample"), id_text(key)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col(label) == 1, min(1.0, ROWS_PER_LABEL / max(1, counts.get(1, 0)))).otherwise(min(1.0, ROWS_PER_LABEL / max(1, counts.get(0, 0))))
    return labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (drawn < share)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Character model over all docs; lexicon from the labelled rows given. Broadcast are the sample's keys and, later, model and lexicon."""
    counts = character_counts(docs, text)
    sample = labelled_sample(labels, key, label)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    rows = docs.join(F.broadcast(sample), F.col(key) == F.col("k")).select("y", text)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharacterModel(shared.value)
        memo: dict[str, list[str]] = {}
        for batch in batches:
            found: Counter = Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries: set[str] = set()
                tokens = tokens_of(t)
                for token in tokens:
                    if token not in memo:
                        if len(memo) > MEMO_ENTRIES:
                            memo.clear()
                        memo[token] = [e for w in words_behind(token, model) for e in entries_of(w)]
                    entries.update(memo[token])
                if y:
                    group = copy_group(t)
                    found.update((e, group) for e in entries)
                else:
                    found.update((e, 0) for e in entries)
                    found[TOKENS, 0] += len(tokens)
            yield pa.RecordBatch.from_pydict({"entry": pa.array([e for e, _ in found], pa.string()), "grp": pa.array([g for _, g in found], pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    tallied = stored(rows.mapInArrow(tally, "entry string, grp long, n long").groupBy("entry", "grp").agg(F.sum("n").alias("n")), "tally")
    both = tallied.groupBy("entry").agg(F.count(F.when(F.col("grp") != 0, 1)).alias("a"), F.coalesce(F.sum(F.when(F.col("grp") == 0, F.col("n"))), F.lit(0)).alias("c"))
    sizes = dict(sample.groupBy("y").count().collect())
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return Model(counts, {}, math.log(1 / 3))
    odds = F.log((F.col("a") + 0.5) / (F.col("c") + 0.5)) - math.log(ones / zeros)
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    weighed = both.where(F.col("a") >= LEAST_GROUPS).select("entry", (odds - 2 * error).alias("w")).where(F.col("w") >= LEAST_WEIGHT)
    strongest = weighed.where("trim(entry) <> ''").collect()
    tokens = tallied.where(F.col("entry") == TOKENS).agg(F.sum("n")).first()[0] or 0
    return Model(counts, {r["entry"]: float(r["w"]) for r in strongest}, math.log(ones / zeros), max(1.0, tokens / zeros))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity, the score of the whole text; no shuffle."""
    kept = [c for c in docs.columns if c != "toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast((model.counts, model.weights, model.prior, model.usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores, pa.float64())], names=[*kept, "toxicity"])

    return docs.mapInArrow(run, docs.select(kept).schema.add("toxicity", "double"))


def op3_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op3: fold 1 of 3 is held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(id_text("doc_id").cast("binary")) % 3
    labels = table(spark, sf_dir, "labels").where(fold != 1)
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", (fold == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_channel_toxicity": op3_channel_toxicity}
