"""Arrow texts as NumPy bytes, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text begins and the last ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = (int(places[0]), int(places[-1])) if len(places) else (0, 0)
    held = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
    return held, places - first


def strings(data: np.ndarray | bytes, places: np.ndarray) -> pa.Array:
    """Texts from their bytes in a row and their places."""
    made = pa.LargeStringArray.from_buffers(
        len(places) - 1, pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(data)
    )
    return made.cast(pa.string())


def blocks(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in runs of about `size` bytes; a longer text is a run of its own. Without texts one empty run."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(length), 0
    while True:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + size, "right")), min(start + 1, len(texts)))
        yield texts.slice(start, stop - start)
        start = stop
        if start >= len(texts):
            return
