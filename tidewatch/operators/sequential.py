"""Sequential per-key folds (recurrences that are not windows).

Some reference detectors update per-key state with a rule that depends on the
state itself (an outlier is not absorbed into the baseline; a blocked address
is not re-blocked until its block expires). No associative combine exists, so
the only exact plan is: hash-partition by key, sort each partition by
``(key, order...)`` (an external, spill-capable sort) and stream it through a
fold that keeps the state of the current key only. Memory per task is O(one
state); keys run in parallel; a hot key is as fast as one core streams it.
Nothing is collected per group.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_UNSET = object()


def _parse_schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def fold_by_key(df: DataFrame, key: str, order: Sequence[str], step: Callable,
                out_schema: str, num_partitions: int | None = None) -> DataFrame:
    """Run ``step(state, row) -> (new_state, out_tuple)`` over each key's rows
    in ``order``; the first row of a key sees ``state=None``. ``row`` is a
    namedtuple: columns read by ``step`` must not start with ``_``. Returns ``df``'s
    columns plus the ``out_schema`` columns, one output row per input row.
    Rows with a NULL key are one key of their own."""
    extra = _parse_schema(out_schema)
    schema = StructType(list(df.schema.fields) + list(extra.fields))
    out_types = to_arrow_schema(extra)
    parts = (df.repartition(num_partitions, key) if num_partitions else df.repartition(key))
    ordered = parts.sortWithinPartitions(key, *order)

    key_pos = df.columns.index(key)
    row_type = namedtuple("Row", df.columns)

    def run(batches):
        current, state = _UNSET, None
        for batch in batches:
            outs = []
            # Arrow values: integers stay integers and NULL stays None
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                k = values[key_pos]
                if current is _UNSET or k != current:
                    current, state = k, None
                state, out = step(state, row_type(*values))
                outs.append(out)
            new = [pa.array([o[i] for o in outs], f.type) for i, f in enumerate(out_types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return ordered.mapInArrow(run, schema)
