"""Terms of whole texts, cut from Arrow buffers without a Python object per word.

A term is a maximal run of digits, letters a-z (A-Z are lower-cased first) and characters beyond ASCII.
"""

import numpy as np
import pyarrow as pa

_SPACE = 32
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)
)
# Bytes of text whose terms are held at once; one longer text is taken whole.
CHUNK_BYTES = 8 << 20


def chunks(column, size=CHUNK_BYTES):
    """(begin, end) of consecutive rows of a string array, at most `size` bytes together or one row."""
    bounds = _offsets(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(bounds, bounds[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, end
        begin = end


def _offsets(column):
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def terms(column):
    """(terms as an Arrow string array, row of each) of a string array, in order; nulls have none."""
    if not len(column) or column.buffers()[2] is None:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    bounds = _offsets(column)
    low, high = int(bounds[0]), int(bounds[-1])
    text = np.frombuffer(bytes(memoryview(column.buffers()[2])[low:high]).translate(_FOLD), np.uint8)
    inside = text != _SPACE
    # The first byte of a text begins a term also where the text before ends in one.
    edge = np.zeros(len(text) + 1, bool)
    edge[bounds - low] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begins = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - begins
    places = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    kind, width = (pa.string(), np.int32) if places[-1] < 1 << 31 else (pa.large_string(), np.int64)
    made = pa.Array.from_buffers(kind, len(begins), [None, pa.py_buffer(places.astype(width)), pa.py_buffer(text[inside])])
    rows = np.searchsorted(bounds[:-1] - low, begins, side="right") - 1
    return made, rows
