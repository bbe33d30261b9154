"""Helpers that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_dir, scratch, stash  # noqa: F401


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast, whatever else ``df`` holds.

    A column is found by its exact name first and then without regard to case, so
    extra columns such as ``TEXT`` beside ``text``, or names that an operator uses
    for its own results, never clash.
    """
    names = df.columns
    bare = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out = []
    for name, kind in types.items():
        at = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not at:
            raise ValueError(f"column {name} is missing from {names}")
        out.append(F.col(f"_c{at[0]}").cast(kind).alias(name))
    return bare.select(*out)


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands: by its exact name first, then without regard to case."""
    at = [i for i, n in enumerate(df.columns) if n == name] or [i for i, n in enumerate(df.columns) if n.lower() == name.lower()]
    if not at:
        raise ValueError(f"column {name} is missing from {df.columns}")
    return at[0]


def append_columns(df: DataFrame, text: str, compute, fields: T.StructType) -> DataFrame:
    """All columns of ``df``, named _c0, _c1, ..., and ``fields`` behind them, which
    ``compute`` makes from a list of texts as Arrow arrays. Rows stay where they are: no
    join brings the results back to whole documents."""
    at = place_of(df, text)
    bare = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    bare = bare.withColumn(f"_c{at}", F.col(f"_c{at}").cast("string"))
    schema = T.StructType([*bare.schema.fields, *fields.fields])

    def run(batches):
        for whole in batches:
            for batch in slices_by_bytes(whole, at):
                yield pa.record_batch([*batch.columns, *compute(batch.column(at).to_pylist())], names=schema.names)

    return bare.mapInArrow(run, schema)


def without_appended(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``append_columns`` was given, under their own names."""
    return df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


class Memo(dict):
    """What ``find`` gives for each key, for a worker. The bytes held are bounded: beyond
    ``MOST`` the younger half is forgotten, and keys over ``LONGEST`` are never kept, so
    unbroken strings of any length cost nothing once they are done. Results do not depend
    on what is held."""

    MOST, LONGEST, EACH = 128 << 20, 64, 250

    def __init__(self, find):
        super().__init__()
        self.find, self.held = find, 0

    def __missing__(self, key: str):
        found = self.find(key)
        if len(key) <= self.LONGEST:
            size = self.EACH + 2 * len(key)
            if self.held + size > self.MOST:
                for old in list(self)[len(self) // 2 :]:
                    del self[old]
                    self.held -= self.EACH + 2 * len(old)
            self[key] = found
            self.held += size
        return found


def slices_by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text in each; a longer text
    stands alone."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
