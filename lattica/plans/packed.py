"""Work on one small graph for each key, many keys in an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

#: Rows of a batch that leaves a Python worker.
BATCH_ROWS = 20_000


def arrow(schema: str) -> pa.Schema:
    """The Arrow form of a Spark schema; only the driver can make it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def record_batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    """Rows as one batch."""
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)


def per_key(rows: DataFrame, run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run`` on the rows of each key, the first column of ``rows``: it gets their other columns
    and gives those of the result, before which the key is put. ``schema`` has the key first."""
    key, *rest = rows.columns
    kind = arrow(schema)
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("rows"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0).to_pylist(), batch.column(1)
            whole = list(zip(*[c.to_pylist() for c in lists.flatten().flatten()], strict=True))
            at, out = 0, []
            for k, n in zip(keys, lists.value_lengths().to_pylist(), strict=True):
                out += [(k, *r) for r in run(whole[at : at + n])]
                at += n
                if len(out) >= BATCH_ROWS:
                    yield record_batch(out, kind)
                    out = []
            yield record_batch(out, kind)

    return packed.mapInArrow(each, schema)
