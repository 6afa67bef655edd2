"""What the operators of this subpackage share: inputs, the shared folder, small hash helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.scratch import released, shared_dir, stored  # noqa: F401 - for the operators

#: The white space of the contracts: words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows of highest n, `limit` at most: as many whole values of n as fit. counts is read twice and should be stored.

    The bound comes from how many rows each value of n has, so no task sends its own best rows to the driver.
    """
    taken, bound = 0, None
    for value, rows in counts.groupBy(n).count().orderBy(F.desc(n)).collect():
        if taken + rows > limit:
            break
        taken, bound = taken + rows, value
    return counts.where(F.col(n) >= bound) if bound is not None else counts.where(F.lit(False))


def scratch_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    name = f"__{base}"
    while name in df.columns:
        name = f"_{name}"
    return name


def id_text(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """The contract's words: A-Z in lower case, split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
