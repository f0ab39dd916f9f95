"""Running a Python function over whole texts, batch by batch in Arrow, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Output is handed over once this many bytes of text are worked off, so that long texts don't pile up.
CHUNK_BYTES = 8 << 20
TEXT = "__text"


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(df: DataFrame, make: Callable[[], Callable], fields: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns of ``df`` (all by default), and ``fields`` from ``make()(text as bytes or None)`` for each row.

    ``make`` runs once in each task, so that a function can hold a cache. Kept columns named as a field give way to it.
    """
    schema = T.StructType.fromDDL(fields)
    keep = [c for c in (df.columns if keep is None else keep) if c not in schema.fieldNames()]
    held_as = unused(keep, TEXT)[0]
    source = df.select(*keep, F.col(text).cast("binary").alias(held_as))
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = [*keep, *schema.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts, start, held, rows = batch.column(batch.num_columns - 1), 0, 0, []
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                rows.append(work(value))
                held += len(value or b"")
                if held >= CHUNK_BYTES or i == batch.num_rows - 1:
                    got = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
                    own = [batch.column(k).slice(start, len(rows)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, *got], names=names)
                    start, held, rows = i + 1, 0, []

    out = T.StructType([*source.select(*keep).schema.fields, *schema.fields])
    return source.mapInArrow(run, out)
