"""Folds over the rows of a group in their order, for rules whose next step depends on the last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def folded(rows: DataFrame, group: str, order: list[str], read: list[str], made: dict[str, str], begin: Callable[[], Any], step: Callable[..., tuple]) -> DataFrame:
    """rows with the columns in made (name -> long, boolean or string): what step(state, *read) returns for each row of a group, in order.

    Rows are dealt by group and sorted within tasks; a task holds one batch and one
    group's state, never a group. Groups may be of any length, but each is one task's work,
    as its steps are sequential. A null group is a group; a column that has a name in made is replaced.
    """
    rows = rows.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in [group, *read]), strict=True):
                if not begun or key != now:
                    now, state, begun = key, begin(), True
                out.append(step(state, *values))
            columns = list(zip(*out, strict=True)) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, ARROW[kind]) for c, kind in zip(columns, made.values(), strict=True))], [*batch.schema.names, *made])

    schema = StructType(list(rows.schema.fields))
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
