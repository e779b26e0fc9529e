"""Words of whole texts: maximal runs of what isn't ASCII white space, an Arrow array at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, words of each text); null is empty."""
    x = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\t-\r]", " ")
    lists = pc.split_pattern(x, " ")
    if not len(lists):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[at]
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    return coded.dictionary, at[real], np.bincount(text[real], minlength=len(lists))
