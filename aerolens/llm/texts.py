"""Per-text work in Arrow batches: a text column goes to Python as UTF-8 bytes, new columns come back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from aerolens.session import importable

#: Maps A-Z to a-z and every ASCII byte but digits and letters to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: What a Python worker keeps from task to task, by name (the tokenizer's tables). Workers outlive jobs, so tasks of ``map_texts`` let go of it.
remembered: dict[str, object] = {}


def let_go() -> None:
    """Empties the worker's ``remembered``; a function sent to the workers would hold a copy of the table itself."""
    remembered.clear()


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six bytes."""
    return text.split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of digits, letters a-z and non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


def given(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """New names for the columns of ``df`` that bear one of an operator's ``names``: ``_given`` is added until nothing clashes.

    This is the rule of all operators that keep the caller's columns: no value is lost, and the result can be used.
    """
    taken, renamed = {c.lower() for c in [*df.columns, *names]}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c
            while new.lower() in taken:
                new += "_given"
            taken.add(new.lower())
            renamed[c] = new
    return renamed


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_texts(df: DataFrame, text: str, add: str | T.StructType,
              make: Callable[[], Callable[[list[bytes | None]], list]]) -> DataFrame:
    """``df`` without ``text``, plus the columns ``add`` computed from it.

    ``make()`` runs once a task and returns a function from the texts of a batch to one
    list or array per new column. Whole texts, one batch at a time; nothing is kept of a
    batch but what the function itself keeps. Columns of ``df`` that bear a new column's name are renamed (see ``given``).
    """
    importable(df.sparkSession)
    added = T.StructType.fromDDL(add) if isinstance(add, str) else add
    df = df.withColumnsRenamed(given(df.select(*[F.col(f"`{c}`") for c in df.columns if c != text]), added.names))
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        of = make()
        for batch in batches:
            if batch.num_rows:
                new = [pa.array(x, kind) for x, kind in zip(of(batch.column(len(kept)).to_pylist()), kinds)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(text)).mapInArrow(run, schema)
