"""Spans in whole texts: (start, end, kind) in code points, their text form, masking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Span = tuple[int, int, str]
SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def merged(spans: Sequence[Span]) -> list[Span]:
    """Spans that overlap or touch as one, with the kind of the first."""
    out: list[Span] = []
    for start, end, kind in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with each merged span replaced by its kind in brackets."""
    parts, last = [], 0
    for start, end, kind in merged(spans):
        parts += [text[last:start], f"[{kind}]"]
        last = end
    return "".join(parts) + text[last:]


def maybe(column: pa.Array, pattern: str) -> list[bool]:
    """Which rows can match, by a linear-time scan; nulls can not."""
    return pc.fill_null(pc.match_substring_regex(column, pattern), False).to_pylist()


def with_columns(
    df: DataFrame, fields: Sequence[T.StructField], rows: Callable[[pa.RecordBatch], Sequence[Sequence]], keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default) and ``fields``, whose values ``rows`` gives by column for each batch."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            values = rows(batch)
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(fields, values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *arrays], schema.names)

    return df.mapInArrow(run, schema)
