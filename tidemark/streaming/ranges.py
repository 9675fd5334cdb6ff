"""A source that plans its own splits: a service that counts and lists rows by range of days, but never more than a cap.

A range whose count reaches the cap is cut in two, until each range is under it; each range is a partition, read by a task. A single day that still
reaches the cap can't be cut: its rows come with a row that warns. A range that can't be read gives a row that names
it and isn't tried again in the run. As a stream the offsets are the range of days that is covered, so a stopped query resumes there, and a
wider range adds its uncovered edges only.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.streaming.events import halves, uncovered

#: Rows that a service counts at most.
CAP = 10_000
#: Columns that tell of a range: what is amiss with it, and its days.
NOTE = "note string, first_day string, last_day string"


class Listing:
    """A service over Parquet files: counts and rows of a range of days, by the column of times."""

    def __init__(self, path: str, time: str, cap: int) -> None:
        self.path, self.time, self.cap = path, time, cap

    def _within(self, first: str, last: str) -> ds.Expression:
        kind = ds.dataset(self.path).schema.field(self.time).type
        ends = (datetime.datetime.fromisoformat(first), datetime.datetime.fromisoformat(last) + datetime.timedelta(days=1))
        a, b = (pa.scalar(x.isoformat(sep=" ") if pa.types.is_string(kind) else x, kind) for x in ends)
        return (ds.field(self.time) >= a) & (ds.field(self.time) < b)

    def count(self, first: str, last: str) -> int:
        """Rows of the range, the cap if there are as many or more."""
        return min(self.cap, ds.dataset(self.path).count_rows(filter=self._within(first, last)))

    def rows(self, first: str, last: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
        yield from ds.dataset(self.path).scanner(columns=columns, filter=self._within(first, last)).to_batches()


@dataclass
class Range(InputPartition):
    first: str
    last: str
    full: bool = False


def leaves(service: Listing, first: str, last: str) -> list[Range]:
    """Ranges under the cap that cover the days from first to last; single days that reach it are full."""
    out, open_ = [], [(first, last)]
    while open_:
        a, b = open_.pop()
        full = service.count(a, b) >= service.cap
        if full and a < b:
            open_ += halves(a, b)[::-1]
        else:
            out.append(Range(a, b, full))
    return out


class _Read:
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields][:-3]
        self.first, self.last = options["first"], options["last"]
        self.service = Listing(options["path"], options["time"], int(options.get("cap", CAP)))

    def read(self, partition: Range) -> Iterator[tuple]:
        nothing = (None,) * len(self.columns)
        try:
            for batch in self.service.rows(partition.first, partition.last, self.columns):
                yield from zip(*(c.to_pylist() for c in batch.columns), *([None] * batch.num_rows for _ in range(3)), strict=True)
        except (OSError, pa.ArrowInvalid) as e:
            yield (*nothing, f"failed: {type(e).__name__}", partition.first, partition.last)
            return
        if partition.full:
            yield (*nothing, "full: rows may be missing", partition.first, partition.last)


class RangeReader(_Read, DataSourceReader):
    def partitions(self) -> list[Range]:
        return leaves(self.service, self.first, self.last)


class RangeStream(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"first": "", "last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"first": self.first, "last": self.last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        covered = (start["first"], start["last"]) if start["first"] else None
        return [x for a, b in uncovered((end["first"], end["last"]), covered) for x in leaves(self.service, a, b)]


class RangeSource(DataSource):
    """Options: path, time (its column of times), first and last (days, both included), cap. The schema is that of the wanted columns and NOTE.

    A range of a stream may be widened from one run to the next, on both sides; it should not be made narrower.
    """

    @classmethod
    def name(cls) -> str:
        return "capped_ranges"

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(schema, self.options)

    def streamReader(self, schema: StructType) -> RangeStream:  # noqa: N802
        return RangeStream(schema, self.options)
