"""Running state over the rows of each group in order, for totals that start anew: no window frame can restart on a computed total.

Groups are sorted within their partition and streamed through a Python step, a row at a time with one state, so a group's size costs
time and no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .select import names


def folded(df: DataFrame, by, order: Sequence[str], step: Callable, out: str, **inputs: Column) -> DataFrame:
    """The rows of ``df`` with the fields ``out``: for each row in ``order``, ``step(state, inputs)`` gives (state, values); a group's
    first state is None, and ``inputs`` are expressions over the row, null as None."""
    keys = names(by)
    taken = {f"__fold_{k}": c for k, c in inputs.items()}
    d = df.withColumns(taken).withColumn("__fold_group", F.struct(*keys)).repartition(*keys).sortWithinPartitions(*keys, *order)
    new = T.StructType.fromDDL(out)
    kept, carried, taken_names = T.StructType([f for f in df.schema] + list(new)), df.columns, list(taken)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, group, state = [to_arrow_type(f.dataType) for f in new], None, None
        for b in batches:
            values = zip(*(b.column(c).to_pylist() for c in taken_names), strict=True) if taken_names else ((),) * b.num_rows
            rows = []
            for g, v in zip(b.column("__fold_group").to_pylist(), values, strict=True):
                if g != group:
                    group, state = g, None
                state, got = step(state, *v)
                rows.append(got)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=kept.names)

    return d.mapInArrow(run, kept)
