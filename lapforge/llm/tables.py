"""Reading the tables, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lapforge.session import cut_lineage

__all__ = ["broadcast_if_small", "cut_lineage", "map_batches", "read_table", "set_aside"]

#: Rows of two or three numbers that may be broadcast (about 40 MB); beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, marked for broadcast if a count finds it within ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it yields dicts of columns in the order of ``schema``."""
    from pyspark.sql.types import StructType
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
                     else columns[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called like one of ``names`` (case aside) renamed, and the renaming that undoes it."""
    used = {c.lower() for c in df.columns} | {n.lower() for n in names}
    back = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            free = next(f"{c}_{k}" for k in range(len(used) + 1) if f"{c}_{k}".lower() not in used)
            used.add(free.lower())
            back[free] = c
    return df.withColumnsRenamed({c: free for free, c in back.items()}), back
