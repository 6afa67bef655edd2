"""Bars by symbol from a provider, read behind a cursor for each symbol: a data source for batches and streams.

A provider says the last day that each symbol has (`latest`) and gives the rows of some symbols in a range of days each (`fetch`, in tasks). A stream's
offset holds the last day read of every symbol, so that a run goes on where the last one stopped, whichever symbols it had come to; a symbol that is new
begins with its first day. The last day read is read again, as a provider may have told it before its close; an upsert by symbol and day makes that
harmless. Symbols are read in ranges, one a task, so that a provider that keeps them together is asked once for a range.

The offset is bounded by the listed symbols, not by their rows: above MOST_SYMBOLS it is refused, and `bars.new_rows` with stored cursors does the same as
a join. Days are ISO texts. A symbol without rows has no last day (None) and is not read; one whose last day goes back is not read again; without
symbols there are no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Symbols that an offset may hold: some 5 MB of it.
MOST_SYMBOLS = 200_000
#: Symbols that one task reads together.
SYMBOLS_PER_TASK = 200

#: A symbol, the last day that has been read (None: nothing) and the last day to read, both included.
Wanted = tuple[str, str | None, str]
Fetch = Callable[[Sequence[Wanted]], Iterator[pa.RecordBatch]]
Latest = Callable[[], Mapping[str, str | None]]


@dataclass
class SymbolRange(InputPartition):
    wanted: tuple[Wanted, ...]


def behind(cursors: Mapping[str, str], ends: Mapping[str, str | None]) -> list[Wanted]:
    """The symbols that have later days than their cursor, or no cursor, in order."""
    return [(s, cursors.get(s), ends[s]) for s in sorted(ends) if ends[s] is not None and (s not in cursors or cursors[s] < ends[s])]


def ranges(wanted: Sequence[Wanted], size: int) -> list[SymbolRange]:
    return [SymbolRange(tuple(wanted[i : i + size])) for i in range(0, len(wanted), size)] or [SymbolRange(())]


def checked(ends: Mapping[str, str | None]) -> Mapping[str, str | None]:
    if len(ends) > MOST_SYMBOLS:
        raise ValueError(f"{len(ends)} symbols: an offset holds {MOST_SYMBOLS} at most; join with stored cursors instead")
    return ends


def symbol_source(name: str, schema: StructType, latest: Latest, fetch: Fetch) -> type[DataSource]:
    """A data source to register with `spark.dataSource.register`, for `read` and `readStream`.

    Options: `mode` full (default) or incremental, for `read`, with `cursors`, a JSON object of last days read; `symbolsPerTask`; and for streams
    `symbolsPerBatch`, the symbols that a micro-batch moves on at most; all are moved by as many batches as that takes, of which availableNow runs one.
    `latest` is called by the driver's Python process and has no Spark session.
    """

    class Rows(DataSourceReader):
        def __init__(self, options: Mapping[str, str]):
            mode = options.get("mode", "full")
            if mode not in ("full", "incremental"):
                raise ValueError(f"mode {mode!r} is neither full nor incremental")
            self.cursors = json.loads(options.get("cursors", "{}")) if mode == "incremental" else {}
            self.size = int(options.get("symbolsPerTask", SYMBOLS_PER_TASK))

        def partitions(self):
            return ranges(behind(self.cursors, checked(latest())), self.size)

        def read(self, partition):
            return fetch(partition.wanted) if partition.wanted else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options: Mapping[str, str]):
            self.size = int(options.get("symbolsPerTask", SYMBOLS_PER_TASK))
            self.step = int(options.get("symbolsPerBatch", MOST_SYMBOLS))
            self.at: dict[str, str] = {}  # where the stream is; after a restart Spark plans the range of its last offset first

        def initialOffset(self):
            return {"days": "{}"}

        def latestOffset(self):
            moved = {s: end for s, _, end in behind(self.at, checked(latest()))[: self.step]}
            self.at = {**self.at, **moved}
            return {"days": json.dumps(self.at, sort_keys=True)}

        def partitions(self, start, end):
            before, after = json.loads(start["days"]), json.loads(end["days"])
            self.at = {**before, **after}
            return ranges(behind(before, after), self.size)

        def read(self, partition):
            return fetch(partition.wanted) if partition.wanted else iter(())

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Rows(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Source


def listed(path: str, symbol: str = "scode", day: str = "trade_date") -> Latest:
    """The last days from a provider's listing, a Parquet folder of one row for each symbol; the latest counts where one has more."""

    def latest() -> dict[str, str | None]:
        rows = ds.dataset(path, format="parquet").to_table(columns=[symbol, day])
        out: dict[str, str | None] = {}
        for s, d in zip(rows.column(0).to_pylist(), pc.cast(rows.column(1), pa.string()).to_pylist()):
            if s is not None:
                out[s] = max(out.get(s) or "", d or "") or None
        return out

    return latest


def parquet_fetch(path: str, columns: Sequence[str], symbol: str = "scode", day: str = "trade_date") -> Fetch:
    """The wanted rows of a Parquet folder: one scan for a range of symbols, whose bounds reach the files' statistics. Days are dates or ISO texts."""

    def fetch(wanted: Sequence[Wanted]) -> Iterator[pa.RecordBatch]:
        rows, days = ds.dataset(path, format="parquet"), {s: (since or "", until) for s, since, until in wanted}
        among = (ds.field(symbol) >= wanted[0][0]) & (ds.field(symbol) <= wanted[-1][0]) & ds.field(symbol).isin(list(days))
        first = min(since for since, _ in days.values())
        if first:
            among &= ds.field(day) >= pa.scalar(first).cast(rows.schema.field(day).type)
        for batch in rows.to_batches(columns=list(columns), filter=among):
            told = zip(batch.column(symbol).to_pylist(), pc.cast(batch.column(day), pa.string()).to_pylist())
            keep = [d is not None and days[s][0] <= d <= days[s][1] for s, d in told]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return fetch
