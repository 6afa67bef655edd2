"""Names and codes found anywhere inside running text, without a word boundary.

A dictionary automaton reads each text once and finds every term in it, overlapping and nested ones too. A dictionary of bounded size is broadcast. A larger
one is cut by a hash of its terms: texts are sent once to each slice, salted over tasks, terms sort before texts within a task, and each task streams its texts through the
automaton of its slice. So no task, and no driver, holds more than one slice of the terms and one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a dictionary, or of a slice of one, that a worker holds; a term costs its own bytes and about so many more.
SLICE_BYTES, TERM_BYTES = 32 << 20, 200


def automaton(terms: Iterable[str]):
    """The Aho-Corasick automaton of the terms, or None without any."""
    found = ahocorasick.Automaton()
    for t in terms:
        if t:
            found.add_word(t, t)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _found(machine, texts: list[str | None]) -> tuple[list[int], list[str]]:
    """Rows and their terms, each term of a row once."""
    rows, terms = [], []
    if machine is not None:
        for i, text in enumerate(texts):
            own = sorted({t for _, t in machine.iter(text)}) if text else []
            rows += [i] * len(own)
            terms += own
    return rows, terms


def mentions(rows: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows without their text, once for each distinct term (a column of `terms`) that the text contains, named in column `term`.

    Null or empty texts and terms match nothing; rows that repeat are found each by itself; repeated terms count once.
    """
    spark = rows.sparkSession
    words = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("term") + TERM_BYTES), F.lit(0))).first()[0]
    carried = [c for c in rows.columns if c not in (text, term)]
    schema = T.StructType([f for f in rows.schema if f.name in carried]).add(term, "string")
    if size <= slice_bytes:
        shared = spark.sparkContext.broadcast([r[0] for r in words.collect()])  # bounded by slice_bytes

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                at, own = _found(machine, batch.column(len(carried)).to_pylist())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(carried))), pa.array(own, pa.string())], names=schema.names)

        return rows.select(*carried, F.col(text).alias("__text")).mapInArrow(scan, schema)

    n_slices = -(-size // slice_bytes)
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_slices))
    numbers = F.sequence(F.lit(0), F.lit(n_slices - 1))
    dealt = rows.select(
        F.explode(numbers).alias("__slice"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("__salt"), F.lit(1).alias("__kind"),
        F.col(text).alias("__text"), *carried)
    names = words.select(
        F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int").alias("__slice"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.lit(0).alias("__kind"),
        F.col("term").alias("__text"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried])
    groups = names.unionByName(dealt).repartition("__slice", "__salt").sortWithinPartitions("__slice", "__salt", "__kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, machine = None, [], None
        for batch in batches:
            slices, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.diff(slices) | np.diff(salt) | np.diff(kind)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if group != (slices[start], salt[start]):
                    group, waiting, machine = (slices[start], salt[start]), [], None
                if kind[start] == 0:
                    waiting += part.column(3).to_pylist()
                    continue
                if waiting:
                    machine, waiting = automaton(waiting), []
                at, own = _found(machine, part.column(3).to_pylist())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(4 + i).take(at) for i in range(len(carried))), pa.array(own, pa.string())], names=schema.names)

    return groups.mapInArrow(stream, schema)


def stock_terms(stocks: DataFrame, codes: bool = True) -> DataFrame:
    """term and scode: what a text calls each stock (scode, sname)."""
    names = stocks.where(F.length("sname") > 0).select(F.col("sname").alias("term"), "scode")
    return names.unionByName(stocks.where(F.length("scode") > 0).select(F.col("scode").alias("term"), "scode")).distinct() if codes else names.distinct()


def stock_mentions(rows: DataFrame, stocks: DataFrame, text: str = "text", codes: bool = True) -> DataFrame:
    """The rows without their text, once for each stock that the text names (by its code too, if `codes`)."""
    terms = stock_terms(stocks, codes)
    found = mentions(rows, terms, text)
    key = [c for c in found.columns if c != "term"]
    both = found.join(terms, "term")
    return both.select(*key, "scode").distinct() if codes else both.select(*key, "scode")
