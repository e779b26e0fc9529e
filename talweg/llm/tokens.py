"""Token ids of whole texts, by the public tokenizer files, a batch at a time.

The vocabulary drops white space and never lets a token span it, so a text's
ids are those of its white-space-separated pieces in turn. A batch is split
with Arrow, its distinct pieces are encoded once by the tokenizers library
(with a bounded cache across batches) and the ids are gathered with numpy:
the same ids as encoding each text, at a fraction of the time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Pieces that are surely one pre-token that lower-casing alone normalises: the model can take them as they are.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: A letter before one of these always ends a pre-token (not the apostrophe: 's and the like are tokens; nor the bar: special tokens have it).
CLOSED = r"(\p{L})([!-&(-/:-@\[-`{}~])"
#: Bytes of text in one slice, pieces that the cache may hold, and pieces in one call of the tokenizer.
SLICE_BYTES, CACHE_PIECES, CALL_PIECES = 2_000_000, 500_000, 500


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tidy() -> None:
    """Give freed memory back to the system: workers are reused and would keep each stage's peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least; memory that their work freed goes back at the end."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
    tidy()


class Encoder:
    """Encodes Arrow arrays of texts; one for each Python worker and file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.length = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Add the ids of unseen pieces."""
        plain = pc.match_substring_regex(pa.array(new, pa.large_string()), PLAIN).to_numpy(zero_copy_only=False).tolist()
        lower = {w: w.lower() for w, p in zip(new, plain) if p}
        easy = [w for w in dict.fromkeys(lower.values()) if w not in self.index]
        hard = [w for w, p in zip(new, plain) if not p]
        ids: list[int] = []
        length: list[int] = []
        tokenize = self.tok.model.tokenize
        for w in easy:
            got = tokenize(w.translate(self.as_bytes))
            length.append(len(got))
            ids += [t.id for t in got]
        for a in range(0, len(hard), CALL_PIECES):
            for e in self.tok.encode_batch_fast(hard[a : a + CALL_PIECES], add_special_tokens=False):
                length.append(len(got := e.ids))
                ids += got
        self.index.update(zip(easy + hard, range(len(self.length), len(self.length) + len(length))))
        self.index.update((w, self.index[x]) for w, x in lower.items())
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.length = np.concatenate([self.length, np.array(length, np.int64)])
        self.start = np.cumsum(self.length) - self.length

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, ids of each text as int64), an end id closing each text; null is empty."""
        x = pc.fill_null(texts.cast(pa.large_string()), "")
        x = pc.replace_substring_regex(x, CLOSED, r"\1 \2")
        x = pc.replace_substring(pc.replace_substring(x, "\n", " "), "\t", " ")
        lists = pc.split_pattern(x, " ")
        words = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()) if len(lists) else lists.values
        if len(words) == 0:
            at = np.zeros(0, np.int64)
            size = at
        else:
            coded = words.dictionary_encode()
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.index) > CACHE_PIECES:
                self._clear()
            if new := [w for w in pieces if w not in self.index]:
                self._learn(new)
            at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
            size = self.length[at]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        per_text = np.diff(total[bounds - bounds[0]]) if len(lists) else np.zeros(0, np.int64)
        ids = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])] if len(at) else np.zeros(0, np.uint32)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(per_text), np.uint32(end_id))
            per_text = per_text + 1
        return ids, per_text
