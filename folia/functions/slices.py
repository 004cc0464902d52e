"""Python functions of a text as columns, a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts and bytes of them that are Python objects at a time, beside the longest text.
ROWS, BYTES = 256, 1 << 20


def sliced(texts: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of up to so many rows and bytes; a longer text is a slice of its own."""
    lengths = pa.compute.binary_length(texts).fill_null(0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= rows or held + n > size):
            yield start, k
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def of_text(make: Callable[[str | None], object], kind: str, text: Column | str) -> Column:
    """``make`` of each text, of the type ``kind``.

    A batch of Spark's is large where texts are, and what is made of a text can be many times its size as Python
    objects: only a slice of them is held at a time, all else as Arrow's compact arrays.
    """
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    def made(texts: pa.Array) -> pa.Array:
        parts = [pa.array([make(t) for t in texts[a:b].to_pylist()], arrow) for a, b in sliced(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(made, kind)(text)
