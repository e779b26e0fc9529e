"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

Shingles are five words (lower case, cut at white space; a shorter text is one
shingle). A shingle weighs its count times 1 + ln(1 / p) / (4 ln(1 / RARE)), where
p is the share of all documents that hold it, ``RARE`` at least; so weights lie
between the count and 1.25 times the count. Shares are counted over all documents
in ``DF_BUCKETS`` hashed buckets. Other shingles add to a bucket's share what a
document has of them by ``DF_BUCKETS``, which is far below ``RARE`` and does not
grow with the number of documents: the weights are the same at every size.

Improved consistent weighted sampling draws ``BANDS`` x ``ROWS`` samples of each
text; texts that agree on all samples of a band meet in a bucket. Candidates
that agree on enough samples are verified by weighted Jaccard similarity. No
bucket's pairs are listed: texts equal word for word are one from the start;
then

1. each text of a bucket is verified against the bucket's least id;
2. where a bucket's texts still lie in several components, those outside the
   largest are compared with all the bucket's texts exactly, block by block:
   counts as unit levels make the sum of minima a matrix product, and only a
   spanning forest of the links found leaves a block. Blocks are bounded by rows
   and by bytes of text. Texts of the largest component are connected already.

So no link between different texts of a bucket is lost, and none is listed for
each pair. The other steps are partial aggregates or joins of many rows with one
row a bucket or document, which adaptive execution splits where it is hot. Components
are found by distributed contraction (``common.connected_components``).

Nulls and texts without a word are equal to each other; rows without an id are
left out. A document is an id with a text: rows that repeat both are one, and
different texts under one id are documents of their own, each with a row and a
class (texts are named by id and a hash, ``name``). In each class exactly one
document is kept: that of least id, then of least hash. Texts of any length are
read whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common, tokens
from talweg.llm.graph import forest

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 3
#: Samples of 24 that candidates share at least; at the similarity asked for, fewer have odds of some 2 in 10,000.
AGREE = 12
DF_BUCKETS, CHUNK = 1 << 20, 1 << 14
#: Share of documents below which shingles weigh alike.
RARE = 1 / 256
#: Most texts, and code points of text, in a block; columns of one product.
BLOCK, BLOCK_CHARS, COLUMNS = 2048, 8_000_000, 2048
ID_BITS = np.uint64(44)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The shingles of an Arrow array of texts: sorted ids and counts of each, and a key of its words."""

    def __init__(self, texts: pa.Array):
        import xxhash

        x = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(x))
        n = len(lists)
        coded = lists.flatten().dictionary_encode()
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.uint64)
        word = hashed[coded.indices.to_numpy()] if len(hashed) else np.zeros(0, np.uint64)
        size = np.diff(lists.offsets.to_numpy().astype(np.int64)) if n else np.zeros(0, np.int64)
        if len(hashed) and (empty := word == np.uint64(xxhash.xxh64_intdigest(""))).any():
            size = size - np.bincount(np.repeat(np.arange(n), size)[empty], minlength=n)
            word = word[~empty]
        text = np.repeat(np.arange(n), size)
        place = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        self.keys = np.zeros((n, 2), np.uint64)
        some = size > 0
        if some.any():
            starts = (np.cumsum(size) - size)[some]
            for k, salt in enumerate((M1, M3)):
                self.keys[some, k] = np.add.reduceat(mix(word + mix(place * M1 + salt)), starts)
        rolled = word.copy()
        for k in range(1, SHINGLE):
            # The text's next word, or none beyond its end.
            follows = np.zeros(len(word), np.uint64)
            follows[:-k] = np.where(text[k:] == text[:-k], word[k:], 0) if len(word) > k else 0
            rolled = rolled * M1 + follows
        last = np.maximum(size - SHINGLE, 0)
        real = place.astype(np.int64) <= last[text]
        ids = np.sort(text[real].astype(np.uint64) << ID_BITS | mix(rolled[real]) & np.uint64((1 << 44) - 1))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[first, len(ids)]).astype(np.float32)
        self.id = ids[first] & np.uint64((1 << 44) - 1)
        self.size = np.bincount((ids[first] >> ID_BITS).astype(np.int64), minlength=n)

    def weights(self, idf: np.ndarray) -> np.ndarray:
        return self.count * idf[(self.id & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]


@cache
def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal shares (Newton on its distribution function)."""
    q = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.maximum(np.sqrt(2 * q), -np.log1p(-q))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-300), 1e-6)
    return x


def samples(ids: np.ndarray, weight: np.ndarray, size: np.ndarray, draws: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples, texts x draws, as 32-bit hashes of (shingle, t); 0 for a text without shingles.

    For each shingle and draw, r and c are Gamma(2, 1), b is uniform, all from
    the shingle's hash; t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the
    sample is the shingle (and t) of the least a.
    """
    out = np.zeros((len(size), draws), np.uint32)
    some = size > 0
    if not some.any():
        return out
    starts = (np.cumsum(size) - size)[some]
    gamma = _gamma_table().astype(np.float32)
    log_gamma = np.log(gamma)
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for k in range(draws):
        h = mix(ids * M1 + np.uint64((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        r = gamma[(h & low).astype(np.int32)]
        b = ((h >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536) + np.float32(1 / 131072)
        t = np.floor(log_w / r + b)
        log_a = log_gamma[((h >> np.uint64(16)) & low).astype(np.int32)] - r * (t - b) - r
        bits = log_a.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
        name = (h >> np.uint64(32)) * np.uint64(2654435761) + t.astype(np.int64).view(np.uint64) * np.uint64(40503)
        packed = (ordered << np.int64(32)) | (name & np.uint64(0xFFFFFFFF)).view(np.int64)
        out[some, k] = (np.minimum.reduceat(packed, starts) & 0xFFFFFFFF).astype(np.uint32)
    return out


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted ids, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    whole = float(a[1].sum(dtype=float) + b[1].sum(dtype=float)) - both
    return both / whole if whole else 0.0


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of each hashed bucket, from all documents: every task counts into one table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(DF_BUCKETS, np.uint32), 0
        for batch in batches:
            for a, b in tokens.slices(batch.column(0)):
                s = Shingles(batch.column(0).slice(a, b - a))
                table += np.bincount((s.id & np.uint64(DF_BUCKETS - 1)).astype(np.int64), minlength=DF_BUCKETS).astype(np.uint32)
                n += b - a
        if n:
            parts = [table[k : k + CHUNK].tobytes() for k in range(0, DF_BUCKETS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "n", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.uint64) for x in group["counts"])
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "n": [group["n"].sum()], "counts": [total.astype("<u8").tobytes()]})

    kind = "chunk int, n long, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("chunk").applyInPandas(add, kind).collect()
    if not rows:
        return np.ones(DF_BUCKETS, np.float32)
    df = np.concatenate([np.frombuffer(r.counts, "<u8") for r in sorted(rows, key=lambda r: r.chunk)]).astype(float)
    n = rows[0].n
    return (1 - np.log(np.clip(df / n, RARE, 1)) / (-4 * np.log(RARE))).astype(np.float32)


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name (16 bytes that sort as id, then a hash of the text), text: the rows that have an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    return rows.select("doc_id", name(F.col("doc_id"), F.col("text")).alias("name"), "text")


def name(doc_id: Column, text: Column) -> Column:
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(digits(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), digits(F.xxhash64(F.coalesce(text, F.lit(""))))))


def id_of(name: Column) -> Column:
    """The id in a name."""
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, name, key (128 bits of the word sequence), bands (64-bit hashes), sig (16 bits a sample)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * M3
        for batch in batches:
            for a, b in tokens.slices(batch.column(2)):
                s = Shingles(batch.column(2).slice(a, b - a))
                got = samples(s.id, s.weights(idf.value), s.size)
                bands = np.zeros((b - a, BANDS), np.uint64) + salt
                for k in range(ROWS):
                    bands = mix(bands * M1 + got.reshape(-1, BANDS, ROWS)[:, :, k].astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel(), pa.int64()))
                short = got.astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in s.keys], pa.binary()), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "name", "key", "bands", "sig"])

    return docs.select("doc_id", "name", "text").mapInArrow(sign, "doc_id long, name binary, key binary, bands array<long>, sig binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of the pairs (a, b, sig_a, sig_b) that share ``AGREE`` samples or more."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(some, "a binary, b binary").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, text) of the names ``wanted``, one row each however often a row repeats."""
    return docs.select("name", "text").join(common.hinted(wanted), "name", "left_semi").dropDuplicates(["name"])


def verified(pairs: DataFrame, docs: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard similarity is high enough, as edges (src, dst)."""
    pairs = common.written(pairs, "pairs")
    texts = common.written(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()), "texts")
    left = texts.withColumnsRenamed({"name": "a", "text": "text_a"})
    right = texts.withColumnsRenamed({"name": "b", "text": "text_b"})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tokens.slices(batch.column("text_a"), 2_000_000):
                part, n = batch.slice(lo, hi - lo), hi - lo
                # A text that many pairs share is cut into shingles once.
                at = pa.concat_arrays([part.column("a"), part.column("b")]).dictionary_encode().indices.to_numpy()
                first = np.unique(at, return_index=True)[1]
                texts = pa.concat_arrays([part.column("text_a").cast(pa.large_string()), part.column("text_b").cast(pa.large_string())])
                s = Shingles(texts.take(pa.array(first)))
                w, ends = s.weights(idf.value), np.cumsum(s.size)
                vectors = [(s.id[e - n : e], w[e - n : e]) for e, n in zip(ends.tolist(), s.size.tolist())]
                good = [jaccard(vectors[at[k]], vectors[at[n + k]]) >= similarity for k in range(n)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    edges = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "src binary, dst binary")
    return common.written(edges, "edges")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name, class (the least name of its group), copies (rows that repeat it): one row a document."""
    spark = docs.sparkSession
    docs = named(docs, id_col, text_col)
    idf = spark.sparkContext.broadcast(document_frequencies(docs))  # 4 MB, whatever the input
    signed = common.written(signatures(docs, idf), "signatures")
    distinct = signed.groupBy("key").agg(F.min("name").alias("a"), F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"), F.min("sig").alias("sig_a"))
    banded = distinct.select("a", "doc_id", "sig_a", F.explode("bands").alias("bucket"))
    # Buckets of one text are most; only the others' rows go on. A bucket's leader is its text of least name.
    met = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1").select("bucket", "low")
    members = common.written(banded.join(met, "bucket"), "buckets")
    lead = members.where("doc_id = low").groupBy("bucket").agg(F.min(F.struct("a", "sig_a")).alias("lead")).select("bucket", F.col("lead.a").alias("b"), F.col("lead.sig_a").alias("sig_b"))
    led = common.written(members.join(lead, "bucket").select("bucket", "a", "b", "sig_a", "sig_b"), "led")
    edges = verified(agreeing(led.where("a <> b")), docs, idf, similarity)

    def apart(edges: DataFrame) -> DataFrame:
        """Rows of buckets whose texts but the leader, which has met all, lie in several components; with their components."""
        component = common.connected_components(edges)
        now = led.select("bucket", "a", "b").join(component.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        mark = now.where("a <> b").withColumn("mark", F.xxhash64("component"))
        open_ = mark.groupBy("bucket").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("bucket")
        return common.written(now.join(open_, "bucket", "left_semi"), "apart")

    edges = edges.union(compared(apart(edges), docs, idf, similarity))
    component = common.connected_components(edges).withColumnRenamed("node", "a")
    groups = signed.groupBy("key").agg(F.min("name").alias("a")).join(component, "a", "left").select("key", F.coalesce("component", "a").alias("class"))
    return signed.select("doc_id", "name", "key").join(groups, "key").groupBy("doc_id", "name", "class").agg(F.count("*").alias("copies"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of its group), kept: one row a document."""
    return classes(docs, similarity, id_col, text_col).select("doc_id", id_of(F.col("class")).alias("class_id"), (F.col("name") == F.col("class")).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (with doc_id and text) without the near-duplicates that aren't kept; rows that repeat an id and a text are one; rows without an id stay."""
    columns = docs.columns
    found = common.written(classes(docs, similarity), "classes")
    rows = docs.withColumn("_name", name(F.col("doc_id"), F.col("text")))
    gone = found.where("name <> class OR copies > 1").select(F.col("name").alias("_name"))
    again = found.where("name = class AND copies > 1").select(F.col("name").alias("_name"))
    once = rows.join(common.hinted(gone), "_name", "left_anti").select(columns)
    first = rows.join(common.hinted(again), "_name", "left_semi").groupBy("_name").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    return once.unionByName(first)


def overlaps(s: Shingles, idf: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the rows x with other rows y of ``s`` (a row with itself is not asked for).

    A shingle that occurs t times is t levels, each of its idf's weight: two
    texts share the levels up to the lesser count, so the sum of minima is a
    product of 0/1 matrices, taken some columns at a time.
    """
    times = s.count.astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(s.size)), s.size), times)
    level = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    weight = idf[(s.id & np.uint64(DF_BUCKETS - 1)).astype(np.int64)].astype(np.float64)
    total = np.bincount(np.repeat(np.arange(len(s.size)), s.size), weights=weight * times, minlength=len(s.size))
    keys, first, column, often = np.unique(np.repeat(s.id, times) | level.astype(np.uint64) << ID_BITS, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(keys), -1)
    place[shared] = np.arange(len(shared))
    column, root = place[column], np.sqrt(np.repeat(weight, times)[first[shared]])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(x), len(y)))
    for a in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(s.size), min(COLUMNS, len(shared) - a)))
        part[row[lo:hi], column[lo:hi] - a] = root[column[lo:hi]]
        both += part[x] @ part[y].T
    return both / np.maximum(total[x][:, None] + total[y][None, :] - both, 1e-300)


def compared(rest: DataFrame, docs: DataFrame, idf, similarity: float) -> DataFrame:
    """Edges (src, dst) that connect what is linked within each bucket: texts outside its largest component against all, by blocks."""
    texts = texts_of(docs, rest.select(F.col("a").alias("name")).distinct()).withColumnRenamed("name", "a")
    largest = rest.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("largest"))
    rows = common.written(rest.join(largest, "bucket").join(texts, "a").select("bucket", "a", "component", "text", (F.col("component") == F.col("largest")).alias("inside")), "compared")
    blocks = lambda these: F.ceil(F.greatest(F.count_if(these) / BLOCK, F.sum(F.when(these, F.length("text")).otherwise(0)) / BLOCK_CHARS)).cast("int")
    sizes = rows.groupBy("bucket").agg(blocks(F.lit(True)).alias("all"), blocks(F.col("inside")).alias("within"), F.greatest(F.lit(1), blocks(~F.col("inside"))).alias("outside"))
    dealt = rows.join(sizes, "bucket").withColumn("h", F.xxhash64("a", F.lit(5)))
    # A bucket that fits is one block. Else the outside's blocks come first; each meets itself and all blocks after it.
    one = F.col("all") <= 1
    dealt = dealt.withColumn("own", F.when(one, 0).when(F.col("inside"), F.col("outside") + F.pmod("h", F.greatest("within", F.lit(1)))).otherwise(F.pmod("h", "outside")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(one, 0).otherwise(F.col("outside") - 1 + F.when(F.col("inside"), 0).otherwise(F.col("within"))))))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "inside", "a", "component", "text")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        group = group.sort_values("a")
        own, name, component = group["own"].to_numpy(), group["a"].to_numpy(), group["component"].to_numpy()
        x, y = np.flatnonzero((own == i) & ~group["inside"].to_numpy(bool)), np.flatnonzero(own == j)
        none = pd.DataFrame({"src": np.zeros(0, object), "dst": np.zeros(0, object)})
        if not len(x) or not len(y) or len(np.unique(component)) < 2:
            return none
        linked = (overlaps(Shingles(pa.array(group["text"], pa.large_string())), idf.value, x, y) >= similarity) & (component[x][:, None] != component[y][None, :])
        left, right = np.nonzero(linked)
        root = forest(len(group), x[left], y[right])
        some = root != np.arange(len(group))
        return pd.DataFrame({"src": name[some], "dst": name[root[some]]})

    return common.written(dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "src binary, dst binary").distinct(), "edges")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
