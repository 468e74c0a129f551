"""Words of UTF-8 texts, as bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z and turns the other ASCII characters, but for digits, into spaces.
PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, lower-cased (A-Z only)."""
    return text.translate(PLAIN).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than ASCII white space: bytes.split() splits at just those."""
    return text.split() if text else []


_FOLLOWING = bytes(range(0x80, 0xC0))


def code_points(text: bytes) -> int:
    """Characters of UTF-8 bytes: those that don't continue one. Holds for broken bytes too."""
    return len(text) if text.isascii() else len(text.translate(None, _FOLLOWING))


def text_column(texts: list[bytes | None], kind: pa.DataType) -> pa.Array:
    """UTF-8 texts as a column; bytes that aren't UTF-8 stay as they are."""
    return pa.array(texts, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).cast(kind, safe=False)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        first = 0
        while first < batch.num_rows:
            last = first + 1
            while last < batch.num_rows and ends[last + 1] - ends[first] <= most:
                last += 1
            yield batch.slice(first, last - first)
            first = last


def raw_texts(part: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A column's texts as UTF-8 bytes."""
    return part.column(column).cast(pa.binary()).to_pylist()


def let_go() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
