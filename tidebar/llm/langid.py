"""Language identification by averaged hashed subword embeddings under a linear softmax.

A text's letters in lower case, everything else as a blank, give subwords: windows of 2, 3 and 4 characters without a blank inside. Each is hashed
to a row of an embedding table; a text is the mean of its rows, and a softmax over a linear map names the language. Embeddings and map are
trained together by stochastic gradient descent in numpy on a bounded sample, with whole texts and random windows of them.

Calibration: a temperature that minimizes the loss on rows that training did not see makes scores probabilities, and rejection uses the
probability that all but one in a thousand of those rows reach (0.5 at most).

As the map is linear, embedding and map are multiplied once, and prediction adds up a few numbers for each subword of the whole text.

Edge cases: a null text, or one without letters, is `und` with score 0 and rejected; equal texts have equal results; rows without a language
are predicted but never learned from; without any labelled row all is `und`; an empty table gives an empty result; other columns pass through, and
those that are named like the results are replaced. Every value of lang is a language, however many there are; the model takes 256 KB for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

#: Bounds of the training sample: rows of each language that are expected in it, and of all languages together.
ROWS_PER_LANGUAGE, ROWS = 1500, 24_000
#: Rows of the embedding table (as a power of two), its width, subword lengths, passes over the sample.
BITS, WIDTH, SUBWORDS, EPOCHS = 16, 12, (2, 3, 4), 4
#: Share of calibration rows that may fall below the rejection bound.
REJECTED_SHARE = 0.001
#: Characters whose subwords are looked up at a time.
BLOCK = 200_000
BLANK = 32

_letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)


def letters_of(text: str) -> np.ndarray:
    """Code points of the text in lower case, blanks for all but letters, one blank at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = _letter[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        known = known.copy()
        for i in np.flatnonzero(codes > 0xFFFF):
            known[i] = chr(codes[i]).isalpha()
    out = np.full(len(codes) + 2, BLANK, dtype=np.uint64)
    out[1:-1] = np.where(known, codes, BLANK)
    return out


def coded(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The letters of each text as 32-bit numbers, all in one buffer: it goes back to the system as a whole, which many small arrays don't."""
    buffer, ends = bytearray(), [0]
    for t in texts:
        buffer += letters_of(t or "").astype(np.uint32).tobytes()
        ends.append(len(buffer) // 4)
    flat = np.frombuffer(buffer, dtype=np.uint32)
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def buckets(codes: np.ndarray) -> np.ndarray:
    """Embedding rows of all subwords."""
    codes = codes.astype(np.uint64, copy=False)
    found, blank = [], codes == BLANK
    for n in SUBWORDS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        inside = np.ones(len(h), dtype=bool)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(h) + i]
            if 0 < i < n - 1:
                inside &= ~blank[i : len(h) + i]
        if n == 2:
            inside = ~(blank[:-1] & blank[1:])
        h = h[inside]
        h ^= h >> np.uint64(29)
        found.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


@dataclass
class Model:
    """languages; table: for each embedding row its share of each language's logit; temperature; the least score that is not rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, text: str | None) -> np.ndarray | None:
        """None where the text has no letters. Long texts are added up block by block, with windows across the seams."""
        codes = letters_of(text or "")
        if not len(self.languages) or not (codes != BLANK).any():
            return None
        total, count = np.zeros(len(self.languages)), 0
        overlap = max(SUBWORDS) - 1
        for at in range(0, max(1, len(codes) - overlap), BLOCK):
            block = codes[at : at + BLOCK + overlap]
            rows = buckets(block)
            if at + BLOCK < len(codes) - overlap:  # what lies wholly in the overlap comes again with the next block
                again = buckets(codes[at + BLOCK : at + BLOCK + overlap])
                total -= self.table[again].sum(axis=0, dtype=np.float64)
                count -= len(again)
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            count += len(rows)
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return "und", 0.0
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: Iterable[str], langs: list[str], held: list[bool], seed: int = 7) -> Model:
    """Fit on rows that are not held, calibrate on held ones (on all where none is held)."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    pairs = [(codes, number[x]) for codes, x in zip(coded(texts), langs)]
    fit = [c for c, h in zip(pairs, held) if not h] or pairs
    check = [c for c, h in zip(pairs, held) if h] or pairs

    def window(codes: np.ndarray) -> np.ndarray:
        size = int(rng.integers(20, 300))
        at = int(rng.integers(0, max(1, len(codes) - size)))
        return codes[at : at + size]

    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    # steps shrink with the squared gradients so far, for each embedding row and for the map
    seen_rows, seen_map = np.full(1 << BITS, 1e-8, dtype=np.float32), np.full(weight.shape, 1e-8, dtype=np.float32)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            codes, y = fit[i]
            rows, counts = np.unique(buckets(codes if epoch % 2 == 0 and len(codes) < 20_000 else window(codes)), return_counts=True)
            if not len(rows):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ embed[rows]
            error = softmax((mean @ weight + bias).astype(np.float64)).astype(np.float32)
            error[y] -= 1
            back = weight @ error
            by_map = np.outer(mean, error)
            seen_map += by_map**2
            weight -= 0.1 * by_map / np.sqrt(seen_map)
            bias -= 0.01 * error
            size = share * np.sqrt((back**2).sum())
            seen_rows[rows] += size**2
            embed[rows] -= (0.1 * share / np.sqrt(seen_rows[rows]))[:, None] * back
    model = Model(languages, (embed @ weight).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)

    def all_logits(cut) -> tuple[np.ndarray, np.ndarray]:
        found = [(model.table[b].mean(axis=0, dtype=np.float64) + model.bias, y) for c, y in check if len(b := buckets(cut(c)))]
        return np.array([z for z, _ in found]).reshape(-1, len(languages)), np.array([y for _, y in found], dtype=np.int64)

    whole, short = all_logits(lambda c: c), all_logits(window)
    z, y = np.concatenate([whole[0], short[0]]), np.concatenate([whole[1], short[1]])
    best = None
    for temperature in np.geomspace(0.02, 5, 60):
        scaled = z / temperature
        top = scaled.max(axis=1, initial=-np.inf)
        loss = float((top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(y)), y]).mean()) if len(y) else 0.0
        if best is None or loss < best[0]:
            best = (loss, float(temperature))
    model.temperature = best[1]
    scores = [softmax(x / model.temperature).max() for x in whole[0]]
    model.least = min(0.5, float(np.quantile(scores, REJECTED_SHARE))) if scores else 0.0
    return model


def fit(docs: DataFrame, learn: Column, calibrate: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Train on a sample of the rows for which `learn` holds; of these, those for which `calibrate` holds calibrate.

    Counts of each language are over all rows; a row is in the sample if its hash is below its language's share, so the sample is the same each time.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), calibrate.alias("c"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return train([], [], [])
    each = min(ROWS_PER_LANGUAGE, max(1, ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), id_text("k"), F.length("t")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(F.col("l").isin(list(counts)) & (drawn < share[F.col("l")])).select("k", "t", "l", "c")
    found = sample.orderBy("k", "t").toArrow()
    model = train((t.as_py() for t in found.column("t")), found.column("l").to_pylist(), found.column("c").to_pylist())
    del found
    pa.default_memory_pool().release_unused()  # the driver lives on
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the three columns named by `added`, from the whole texts; no shuffle. Columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(kept).schema.add(added[0], "string").add(added[1], "double").add(added[2], "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            langs, scores = [x for x, _ in found], [s for _, s in found]
            accepted = [x != "und" and s >= model.least for x, s in found]
            columns = [batch.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def fold(folds: int, key: str = "doc_id") -> Column:
    return F.crc32(id_text(key).cast("binary")) % folds


def op1_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op1: fold 2 of 4 is held out; folds 0 and 1 train, fold 3 calibrates."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold(4) != 2, fold(4) == 3)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op1_subword_langid": op1_subword_langid}
