"""The few helpers that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.shared import shared_dir, written

__all__ = ["LOWER", "SPACE", "UPPER", "fresh", "lower_ascii", "pieces", "shared_dir", "written"]

#: Bytes of a batch that a task turns into Python objects and back at a time.
PIECE_BYTES = 1 << 21

#: ASCII white space, as words are split by it: 0x20 and 0x09 to 0x0D.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col):
    """A-Z to a-z, all else as it is (lower() would also fold other letters)."""
    return F.translate(col, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batches):
    """All rows of Arrow batches, in their order, in parts of about PIECE_BYTES: a batch has 10,000 rows, however
    long their texts are, and a worker keeps the memory that its largest part took."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        del batch
        pa.default_memory_pool().release_unused()
