"""Sequence packing as vector bin packing with the dot-product heuristic.

Every piece is a vector (tokens, segments, loss-bearing tokens) and every
sequence a bin with a capacity in each. A bin is opened with the largest piece
that is left; then, again and again, of the pieces that fit, the one whose
vector has the largest dot product with what the bin has left (each dimension
as a share of its capacity) goes in. Pieces may be cut: whole sequences are cut
off long examples first, and where nothing fits any more the piece that fills
the bin exactly is cut from the largest that is left. What remains at a task's
end is cut into lengths that are powers of two, which need no padding.

``pack_vectors`` packs one bounded buffer of pieces; ``pack_documents`` runs it
in every Spark task over buffers of ``BUFFER`` pieces: no shuffle, and no more
in memory than one buffer and one Arrow batch. Equal lengths are taken in the
order of arrival, so a task that is run again gives the same sequences.

Nulls: a null text is empty and packs as its end id. Repeated rows and repeated
ids are packed once for each row. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common, tokens

LIMIT, SEGMENTS, BUFFER = 4096, 256, 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padding long"
#: Sequences that one task can number.
NUMBERED = 1 << 36


def pack_vectors(sizes: np.ndarray, loss: np.ndarray, limit: int = LIMIT, segments: int = SEGMENTS, loss_limit: int | None = None, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, from, to) for pieces with ``sizes`` tokens of which ``loss`` bear loss.

    A cut piece's loss-bearing tokens are its last ones (a prompt comes first).
    Without ``cut`` pieces stay whole; one that no bin can hold raises.
    """
    loss_limit = limit if loss_limit is None else loss_limit
    cap = np.array([limit, segments, loss_limit], float)
    at = np.zeros(len(sizes), np.int64)
    left = np.asarray(sizes, np.int64).copy()
    prompt = left - np.asarray(loss, np.int64)

    def bears(i: int, a: int, b: int) -> int:
        return int(b - max(a, min(b, prompt[i])))

    def longest(i: int, room: np.ndarray) -> int:
        """Tokens of piece i, from where it is, that the room can take."""
        free = max(0, int(prompt[i] - at[i]))
        n = min(left[i], room[0])
        return int(min(n, free + room[2]) if n > free else n)

    bins = []
    whole = np.arange(len(sizes))
    while (left > 0).any():
        room = np.array([limit, segments, loss_limit], np.int64)
        items: list[tuple[int, int, int]] = []
        todo = whole[left > 0]
        while room[0] > 0 and room[1] > 0 and len(todo):
            need = left[todo]
            bearing = np.minimum(need, np.maximum(0, at[todo] + need - np.maximum(at[todo], prompt[todo])))
            fits = (need <= room[0]) & (bearing <= room[2])
            share = room / np.maximum(cap, 1)
            if fits.any():
                score = np.where(fits, (need / cap[0]) * share[0] + (1 / cap[1]) * share[1] + (bearing / cap[2]) * share[2], -1)
                i = int(todo[score.argmax()])
                n = int(left[i])
            elif cut:
                i = int(todo[need.argmax()])
                n = longest(i, room)
                if n <= 0 and not items:
                    raise ValueError("a limit leaves no room for a token")
                if n <= 0:
                    break
            elif not items:
                raise ValueError("a piece exceeds the limits of an empty sequence")
            else:
                break
            items.append((i, int(at[i]), int(at[i]) + n))
            room -= (n, 1, bears(i, int(at[i]), int(at[i]) + n))
            at[i] += n
            left[i] -= n
            if n == limit:
                break
            todo = todo[left[todo] > 0]
        bins.append(items)
    return bins


def padded(length: int, limit: int = LIMIT) -> int:
    """Padding of a sequence: to the limit, but none at a power of two."""
    return 0 if length & (length - 1) == 0 else limit - length


def powers(items: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A bin's pieces in order, cut into bins whose lengths are powers of two."""
    total, out, held = sum(b - a for _, a, b in items), [], list(items)[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        now = []
        while room:
            i, a, b = held.pop()
            n = min(room, b - a)
            now.append((i, a, a + n))
            if a + n < b:
                held.append((i, a + n, b))
            room -= n
        out.append(now)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, segments: int = SEGMENTS, loss_limit: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """One row a piece (``PIECES``).

    ``prompt_col``: how many of a row's first tokens bear no loss (null, negative: none; at most all). Without it every
    token bears loss, as in plain documents.
    """
    tokenizer = tokenizer or tokens.tokenizer_path()
    #: Whole sequences may be cut off a long row without a choice.
    free = loss_limit is None or loss_limit >= limit

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.Encoder.of(tokenizer)
        sequence = TaskContext.get().partitionId() * NUMBERED
        # Pieces that wait: (document's id, its tokens, ids before the piece, the piece's ids, the prompt's tokens in it).
        held: list[tuple] = []

        def rows(bins: list, pieces: list[tuple]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for items in bins:
                pad, offset = padded(sum(b - a for _, a, b in items), limit), 0
                for i, a, b in items:
                    name, total, start, ids, prompt = pieces[i]
                    out.append((name, start + a, b - a, zlib.crc32(ids[a:b]), total, sequence, offset, b - max(a, min(b, prompt)), pad))
                    offset += b - a
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 9)], names=[c.split()[0] for c in PIECES.split(", ")])

        def flush(last: bool) -> pa.RecordBatch:
            """Pack what waits; the last bin's pieces wait for the next buffer, if there is one."""
            bins = pack_vectors(np.array([len(h[3]) for h in held]), np.array([len(h[3]) - h[4] for h in held]), limit, segments, loss_limit)
            waits = [] if last or not bins or padded(sum(b - a for _, a, b in bins[-1]), limit) == 0 else bins.pop()
            # A bin that a limit other than tokens has closed is cut, too.
            batch = rows([x for items in bins for x in (powers(items) if padded(sum(b - a for _, a, b in items), limit) else [items])], held)
            held[:] = [(n, t, s + a, ids[a:b], max(0, min(b, p) - a)) for i, a, b in waits for n, t, s, ids, p in [held[i]]]
            return batch

        for batch in batches:
            names, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in tokens.slices(batch.column(1)):
                ids, lengths = encoder.encode(batch.column(1).slice(a, b - a))
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                for name, prompt, e, n in zip(names[a:b], prompts[a:b], ends.tolist(), lengths.tolist()):
                    prompt = max(0, min(n, prompt or 0))
                    cut = n - n % limit if free else 0
                    if cut:
                        yield rows([[(0, k, k + limit)] for k in range(0, cut, limit)], [(name, n, 0, ids[e - n : e], prompt)])
                    if n > cut:
                        held.append((name, n, cut, ids[e - n + cut : e].copy(), max(0, prompt - cut)))
                    if len(held) >= BUFFER:
                        yield flush(False)
        if held:
            yield flush(True)

    prompt = F.lit(0).cast("long") if prompt_col is None else docs[prompt_col].cast("long")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), prompt.alias("prompt")).mapInArrow(pack, PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of at most 4096 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
