"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are chosen among the distinct vectors; each vector is
described by its nearest pivots in order of cosine, and stands in the
inverted list of each. Two vectors that share enough pivots are candidates; only candidates' cosines are computed, in double precision.

There are ``PER_ROOT`` times the square root of n pivots (n distinct vectors),
so that a list holds some sqrt(n) of them and the counting of shared pivots
grows with n^1.5; their number lies between ``LEAST`` and ``MOST``, so what is
broadcast is ``MOST`` vectors at most. Within a list, shared pivots are counted
by merging the lists of the other pivots, not by comparing all with all.

A pair meets in every list that it shares, and counts in the one of the least
pivot only. Long lists are dealt into blocks by hash, and each pair of blocks is
a group of bounded size: pairs are counted where they are found, and only a
spanning forest of their links leaves a group, so a cluster of any size costs no
row for each of its pairs. Exact copies are one vector until the end. Components
come from the forests (``common``).

Pivots come from a bounded sample (``SAMPLE`` times their number, the vectors of
least hash). Vectors and pivots are described by what they differ from the
sample's mean: embeddings often share a direction, and would all be near the same
pivots else. Pivots are kept apart: one whose cosine to an earlier pivot is above
``apart`` is left out. So a cluster has a pivot or a few, however many rows it
holds, and its members agree on their nearest ones. Where the sample has fewer
such vectors there are fewer pivots and longer lists. How many nearest pivots
describe a vector, and how many a pair has to share, is tried on the sample:
vectors of it are turned, by the angle of the threshold, towards others of it
(``TRIALS``), and pairs of it that link are taken, if they are many enough to tell. Of each of ``DEPTHS`` the most shared pivots count that find ``TARGET`` of
them, and the first depth is taken at which no more than ``FEW`` of other pairs of the sample are candidates.
Every vector is indexed, whatever its label; cosines are those of the vectors themselves.

Nulls: a vector that is null, zero, or that holds null or non-finite components
links with nothing and stays, a component of its own. Vectors are compared with
those of their own length: each length has an index. Rows that share a vec_id
are one vector (the least array); rows without one are left out. Ties in cosine
go to the first pivot. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common
from talweg.llm.graph import forest

COSINE, BLOCK = 0.95, 2048
PER_ROOT, LEAST, MOST = 4, 256, 4096
SAMPLE, APART = 8, 0.5
#: How many pivots may describe a vector, the part of the trial pairs that is to be found, the part of other pairs that may be candidates, trial pairs and how many tell.
DEPTHS, TARGET, FEW, TRIALS, LEAST_TRIALS = (8, 12, 16, 24, 32, 48, 64), 0.97, 0.02, 1024, 64
#: Pairs whose cosines are computed at once, and how near to the threshold a matrix product is computed again pair by pair.
PAIRS, EXACT = 1 << 16, 1e-9
#: Pairs of rows of one shared pivot from which on they are counted as a block.
DENSE = 1 << 12


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no under- or overflow in the norm
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector's numbers as bytes: in single precision where that is exact, else in double."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    exact = (short == vectors).all(axis=1)
    return [s.tobytes() if e else v.tobytes() for s, v, e in zip(short, vectors.astype(np.float64), exact.tolist())]


def unpacked(column, width: int) -> np.ndarray:
    """Unit vectors, in double precision, of what ``packed`` gave."""
    out = np.empty((len(column), width))
    for k, x in enumerate(column):
        out[k] = np.frombuffer(x, np.float32 if len(x) == 4 * width else np.float64)
    return _unit(out) if len(out) else out


def keep_apart(units: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first ``most`` of the unit vectors that have no cosine above ``apart`` to one before."""
    kept = np.zeros((most, units.shape[1]))
    m = 0
    for u in units:
        if m < most and not (kept[:m] @ u > apart).any():
            kept[m] = u
            m += 1
    return kept[:m]


def centred(units: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions from the mean; zero for a vector that is the mean."""
    d = units - mean
    size = np.sqrt((d * d).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, d / np.maximum(size, 1e-9), 0.0)


def nearest_pivots(directions: np.ndarray, reference: np.ndarray, depth: int) -> np.ndarray:
    """The pivots nearest to each direction, in order; a tie goes to the first."""
    return np.concatenate([np.argsort(-np.round(directions[k : k + 1024] @ reference.T, 12), axis=1, kind="stable")[:, :depth] for k in range(0, len(directions), 1024)]).reshape(len(directions), depth)


def turned(units: np.ndarray, cosine: float, trials: int = TRIALS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at exactly this cosine: vectors of the sample, turned towards others of it."""
    rng = np.random.default_rng(6)
    a, b = units[rng.integers(0, len(units), trials)], units[rng.integers(0, len(units), trials)]
    across = b - (a * b).sum(1, keepdims=True) * a
    size = np.sqrt((across * across).sum(1, keepdims=True))
    good = size[:, 0] > 1e-6
    a, across = a[good], across[good] / size[good]
    return a, cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * across


def linked_in_sample(units: np.ndarray, cosine: float, trials: int = TRIALS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sample's first ``2 * trials`` vectors that link, but ``trials`` of them at most."""
    some = units[: 2 * trials]
    i, j = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    take = np.random.default_rng(7).permutation(len(i))[:trials]
    return some[i[take]], some[j[take]]


def depth_and_shared(units: np.ndarray, mean: np.ndarray, reference: np.ndarray, cosine: float, depths: tuple[int, ...] = DEPTHS) -> tuple[int, int]:
    """How many pivots describe a vector and how many a pair has to share, tried on the sample (see the module)."""
    top = min(max(depths), len(reference))
    near = lambda u: nearest_pivots(centred(u, mean), reference, top)
    trials = [(near(a), near(b)) for a, b in (turned(units, cosine), linked_in_sample(units, cosine)) if len(a) >= LEAST_TRIALS]
    if not trials:
        return min(depths[0], top), 1
    others = near(units[:TRIALS])
    best: tuple = (2.0, 0, 0)
    for depth in sorted({min(d, top) for d in depths}):
        both = [(a[:, :depth, None] == b[:, None, :depth]).any(2).sum(1) for a, b in trials]
        # The most shared pivots that enough pairs have; at the last depth one at least.
        shared = max([s for s in range(1, depth + 1) if all((x >= s).mean() >= TARGET for x in both)], default=1 if depth == top else 0)
        if shared:
            listed = np.zeros((len(others), len(reference)), np.float32)
            np.put_along_axis(listed, others[:, :depth], 1, 1)
            met = float((listed @ listed.T >= shared).mean())
            best = min(best, (met, depth, shared))
            if met <= FEW:
                break
    return best[1:]


def candidates(near_a: np.ndarray, near_b: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which rows of a and b share ``shared`` pivots or more, of the pairs whose least shared pivot is this one.

    Both stand in this pivot's list; the lists of the others are merged, one pivot at a time.
    """
    count, elsewhere = np.ones((len(near_a), len(near_b)), np.uint8), np.zeros((len(near_a), len(near_b)), bool)

    def lists(near: np.ndarray) -> tuple[np.ndarray, ...]:
        rows, flat = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
        order = np.argsort(flat, kind="stable")
        names, first, n = np.unique(flat[order], return_index=True, return_counts=True)
        return names, first, n, rows[order]

    (names_a, first_a, n_a, rows_a), (names_b, first_b, n_b, rows_b) = lists(near_a), lists(near_b)
    names, at_a, at_b = np.intersect1d(names_a, names_b, assume_unique=True, return_indices=True)
    first_a, n_a, first_b, n_b = first_a[at_a], n_a[at_a], first_b[at_b], n_b[at_b]
    size = n_a * n_b
    # A pair that shares a lesser pivot is counted in that pivot's list.
    for these, mark in ((names < pivot, True), (names > pivot, False)):
        for k in np.flatnonzero(these & (size > DENSE)).tolist():
            cell = np.ix_(rows_a[first_a[k] : first_a[k] + n_a[k]], rows_b[first_b[k] : first_b[k] + n_b[k]])
            if mark:
                elsewhere[cell] = True
            else:
                count[cell] += 1
        few = np.flatnonzero(these & (size <= DENSE))
        ends = np.cumsum(size[few])
        # Short lists' pairs are written out side by side, so many at a time.
        for part in np.split(few, np.flatnonzero(np.diff(ends // PAIRS)) + 1) if len(few) else []:
            n = size[part]
            k = np.repeat(part, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = rows_a[first_a[k] + place // n_b[k]], rows_b[first_b[k] + place % n_b[k]]
            if mark:
                elsewhere[i, j] = True
            else:
                np.add.at(count, (i, j), 1)
    return ~elsewhere & (count >= shared)


def links_within(a: np.ndarray, b: np.ndarray, near_a: np.ndarray, near_b: np.ndarray, pivot: int, shared: int, cosine: float) -> np.ndarray:
    """Which rows of a and b are candidates and link."""
    pair = candidates(near_a, near_b, pivot, shared)
    rows, columns = np.flatnonzero(pair.any(1)), np.flatnonzero(pair.any(0))
    linked = np.zeros_like(pair)
    if 8 * np.count_nonzero(pair) > len(rows) * len(columns):
        # Nearly all are candidates: a matrix product, and what is near the threshold once more, so that no decision hangs on the way.
        got = a[rows] @ b[columns].T
        here = pair[np.ix_(rows, columns)]
        linked[np.ix_(rows, columns)] = here & (got >= cosine)
        x, y = np.nonzero(here & (np.abs(got - cosine) < EXACT))
        x, y = rows[x], columns[y]
    else:
        x, y = np.nonzero(pair)
    for k in range(0, len(x), PAIRS):
        i, j = x[k : k + PAIRS], y[k : k + PAIRS]
        linked[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    return linked


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, pivots: int | None = None, nearest: int | None = None, shared: int | None = None, block: int = BLOCK, apart: float = APART) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    rows = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = common.written(rows.withColumn("v", F.when(sound, F.col("v"))), "vectors")
    # An embedding column has one length, or a few.
    widths = [r.d for r in rows.where("v IS NOT NULL").select(F.size("v").alias("d")).distinct().collect()]
    distinct = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    whole = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    for width in sorted(widths):
        found = linked(distinct.where(F.size("v") == width), width, cosine, pivots, nearest, shared, block, apart)
        links = found.groupBy("first").agg(F.sum("links").alias("links"))
        component = common.connected_components(found.where("first <> to"), "first", "to").withColumnRenamed("node", "first")
        copies = distinct.where(F.size("v") == width).join(links, "first", "left").join(component, "first", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "first").alias("c"))
        whole = whole.unionByName(rows.where(F.size("v") == width).join(copies, "v").select("vec_id", "n", "c"))
    return whole.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept"))


def linked(distinct: DataFrame, width: int, cosine: float, pivots: int | None, nearest: int | None, shared: int | None, block: int, apart: float) -> DataFrame:
    """(first, links, to) of each group of the index: a vector's links there, and its parent in their forest."""
    spark = distinct.sparkSession
    if pivots is None:
        pivots = min(MOST, max(LEAST, PER_ROOT * math.isqrt(distinct.count())))
    # A bounded sample: SAMPLE vectors a pivot.
    sample = distinct.orderBy(F.xxhash64("v"), "first").limit(SAMPLE * pivots).select("v").toArrow()["v"].combine_chunks()
    units = _unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    mean = units.mean(axis=0)
    reference = keep_apart(centred(units, mean), pivots, apart)
    depth, need = depth_and_shared(units, mean, reference, cosine, (nearest,) if nearest else DEPTHS)
    need = min(shared or need, depth)
    # MOST vectors at most.
    sent = spark.sparkContext.broadcast((mean, reference))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                mean_, reference_ = sent.value
                near = nearest_pivots(centred(_unit(v), mean_), reference_, depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, depth), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("copies"), pa.array(packed(v), pa.binary()), lists], names=["first", "copies", "v", "near"])

    index = common.written(distinct.mapInArrow(describe, "first long, copies long, v binary, near array<int>"), "index")
    sizes = index.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    # A row a pivot, ``MOST`` at most.
    posted = index.withColumn("pivot", F.explode("near")).join(F.broadcast(sizes), "pivot")
    posted = posted.withColumn("own", F.pmod(F.xxhash64("first", F.lit(11)), F.col("n")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    posted = posted.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "first", "copies", "v", "near")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key
        group = group.sort_values("first")
        parts = []
        for k in dict.fromkeys((i, j)):
            g = group[group["own"] == k]
            parts.append((g["first"].to_numpy(), g["copies"].to_numpy(), unpacked(g["v"], width), np.array(g["near"].to_list(), np.int64).reshape(len(g), depth)))
        if i == j:
            parts *= 2
        (name_a, copies_a, a, near_a), (name_b, copies_b, b, near_b) = parts
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("first", "links", "to")})
        if not len(a) or not len(b):
            return none
        linked = links_within(a, b, near_a, near_b, pivot, need, cosine)
        if i == j:
            np.fill_diagonal(linked, False)
            names, links = name_a, linked @ copies_a
            left, right = np.nonzero(np.triu(linked))
        else:
            names, links = np.concatenate([name_a, name_b]), np.concatenate([linked @ copies_b, copies_a @ linked])
            left, right = np.nonzero(linked)
            right = right + len(a)
        some = links > 0
        if not some.any():
            return none
        order = np.argsort(names, kind="stable")  # so that a tree's root is its least name
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        to = names[order][forest(len(names), place[left], place[right])][place]
        return pd.DataFrame({"first": names[some], "links": links[some], "to": to[some]})

    return common.written(posted.groupBy("pivot", "i", "j").applyInPandas(compare, "first long, links long, to long"), "links")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all ``embeddings``."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
