"""Arrow column functions that go through their input in small pieces.

A batch may hold ten thousand long texts. What is made of them as Python objects, and what
goes back, is made for a few hundred at a time, so a worker's memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

ROWS = 256


def in_pieces(run: Callable[[list | pa.Array], pa.Array], kind: DataType, arrow: bool = False) -> Callable[[Column], Column]:
    """A column function of ``run``, which turns a list of values (an Arrow array, if ``arrow``) into as many results."""

    @F.arrow_udf(kind)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                piece = b.slice(at, ROWS)
                yield run(piece if arrow else piece.to_pylist())

    return each


def columns(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.StructArray:
    """Rows as an array of structs."""
    each = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(each, kinds, strict=True)], names=names)
