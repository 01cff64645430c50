"""Words of letters, digits and non-ASCII characters, cut from whole Arrow
columns of texts without Python objects for single words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte by byte: A-Z become a-z; digits, a-z and the bytes of non-ASCII
#: characters stay; every other byte is a blank between words.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def _plain(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of a column of texts; a null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    return at, memoryview(data if data is not None else b"")


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where those of each text
    begin (with the end: one entry more than texts)."""
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(1, dtype=np.int64)
    at, data = _plain(texts)
    low = bytes(data[at[0]: at[-1]]).translate(TABLE)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(low))
    lists = pc.ascii_split_whitespace(clean)
    words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.not_equal(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        words = words.filter(full)
    return words, starts


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text (a
    longer text is a run of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = _plain(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
