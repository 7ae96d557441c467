"""Arrow batches of texts, cut so that a task holds a few megabytes of text at a time."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step handles at once; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def steps(batches, text="text", size=STEP_BYTES):
    """Yield (record batch slice, texts as bytes); a null text is empty. Only a step's texts are Python objects at a time."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        cuts, held = [0], 0
        for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if held and held + n > size:
                cuts.append(i)
                held = 0
            held += n
        for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            if start < end:
                yield batch.slice(start, end - start), [x or b"" for x in column.slice(start, end - start).to_pylist()]


def lists(values: np.ndarray, counts) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
