"""Folds over the rows of a group in order, for rules whose every row depends on what was decided before.

Groups are sorted within their partition and streamed through a task with a state of fixed size: a group of any length takes linear
time and no memory, and is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def fold_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], reads: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], out: str, kind: DataType) -> DataFrame:
    """``df`` with the column ``out`` (in its place if it exists): ``step(state, values of reads)`` gives the next state and a row's value;
    ``start()`` is the state before a group's first row."""
    names = df.columns
    fields = [StructField(out, kind) if f.name == out else f for f in df.schema.fields]
    if out not in names:
        fields.append(StructField(out, kind))
    schema = StructType(fields)
    keys, read = [names.index(k) for k in key], [names.index(c) for c in reads]
    place, arrow = ([f.name for f in fields].index(out), to_arrow_type(kind))

    def changes(columns: list[pa.Array]) -> list[int]:
        """The rows from 1 on that differ from the row before in any column; nulls are alike."""
        n, out = len(columns[0]) - 1, None
        for c in columns:
            here, before = c.slice(1), c.slice(0, n)
            differs = pc.or_kleene(pc.not_equal(here, before), pc.xor(here.is_null(), before.is_null())).fill_null(False)
            out = differs if out is None else pc.or_(out, differs)
        return [k + 1 for k in pc.indices_nonzero(out).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = []
            rows = list(zip(*(batch.column(k).to_pylist() for k in read), strict=True))
            # Keys become Python values only where a group begins.
            begins = [0, *changes([batch.column(k) for k in keys]), batch.num_rows]
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                own = tuple(batch.column(k)[a].as_py() for k in keys)
                if own != last:
                    last, state = own, start()
                for row in rows[a:b]:
                    state, value = step(state, row)
                    values.append(value)
            columns = list(batch.columns)
            columns[place : place + 1] = [pa.array(values, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
