"""Hashed word features of whole texts, an Arrow batch at a time.

A text is lower-cased and cut at whatever is neither letter nor digit. Each
distinct word gives its own feature and those of its first four and five
characters (stems, where it is longer), hashed into a fixed number of buckets;
a feature's value is 1 + ln(times its word occurs), divided by the fourth root
of the text's words (``ROOT``). Null is empty: no feature.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUCKETS = 1 << 18
#: A text's values are divided by its words to this power: a few telling words must show in long texts, too.
ROOT = 0.25


def word_features(word: str, buckets: int = BUCKETS) -> tuple[int, int, int]:
    """Buckets of the word and of its two stems; -1 where it has no longer form."""
    h = lambda kind, s: zlib.crc32((kind + s).encode()) % buckets
    return h("w", word), h("4", word[:4]) if len(word) > 4 else -1, h("5", word[:5]) if len(word) > 5 else -1


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each occurrence's index among them, occurrences of each text)."""
    x = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    x = pc.utf8_trim(pc.replace_substring_regex(x, r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(x, " ")
    if not len(lists):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at = coded.indices.to_numpy().astype(np.int64)
    size = np.diff(lists.offsets.to_numpy().astype(np.int64))
    if "" in (vocabulary if len(vocabulary) < 1000 else set(vocabulary)):
        empty = at == vocabulary.index("")
        size = size - np.bincount(np.repeat(np.arange(len(size)), size)[empty], minlength=len(size))
        at = at[~empty]
    return vocabulary, at, size


def word_table(vocabulary: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of each word's features, one row a word; ``buckets`` itself stands for none."""
    return np.array([word_features(w, buckets) for w in vocabulary], np.int64).reshape(-1, 3) % (buckets + 1)


def damped(at: np.ndarray, size: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, value) of every distinct word of every text, text by text."""
    pairs, times = np.unique(np.repeat(np.arange(len(size)), size) * max(vocabulary, 1) + at, return_counts=True)
    text = pairs // max(vocabulary, 1)
    return text, pairs % max(vocabulary, 1), (1 + np.log(times)) / np.maximum(size, 1.0)[text] ** ROOT


def sparse(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value) of every feature, text by text; features of each text; words of each text."""
    vocabulary, at, size = words_of(texts)
    text, word, value = damped(at, size, len(vocabulary))
    bucket = word_table(vocabulary, buckets)[word].ravel()
    real = bucket < buckets
    pairs, where = np.unique((np.repeat(text, 3) * buckets + bucket)[real], return_inverse=True)
    return pairs % buckets, np.bincount(where, weights=np.repeat(value, 3)[real], minlength=len(pairs)), np.bincount(pairs // buckets, minlength=len(size)), size


def linear(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each text's features times ``weights``, which may have columns; words of each text)."""
    vocabulary, at, size = words_of(texts)
    with_none = np.concatenate([weights, np.zeros((1, *weights.shape[1:]), weights.dtype)]).astype(float)
    each = with_none[word_table(vocabulary, len(weights))].sum(1)
    text, word, value = damped(at, size, len(vocabulary))
    return sums(each[word] * value.reshape(-1, *[1] * (each.ndim - 1)), np.bincount(text, minlength=len(size))), size


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` (along the first axis); 0 where a run is empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=float)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
