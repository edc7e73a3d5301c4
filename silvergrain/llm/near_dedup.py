"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles: five words in a row (all words, if fewer), weighted by their count times the inverse document frequency. The
latter is ln(N / df) for shingles in at least ``COMMON`` of all documents and ln(1 / COMMON), its largest value,
for the rest, so only common ones have to be told apart; it is at least ``LEAST`` of the largest value, lest a shingle
of all documents weigh nothing. Common shingles are found exactly by two passes: one common overall is common in
some partition; what is common in a partition is counted in all.

Samples: for hash k a shingle of weight w gets t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r, with r
and c of Gamma(2, 1) and beta uniform, all drawn from the shingle and k; a document's sample is the smallest a. Two
documents share a sample with the probability of their weighted Jaccard similarity. ROWS samples make a band.

Links: documents with equal shingles are one node. Within a bucket of a band, all nodes are compared with one pivot, in two rounds:
one by chance, then the one with the largest share of weight that others have too, the least edited of a group. So a group of m near
copies costs about m comparisons a round. A pivot's comparisons are dealt over tasks in parts of ``PART`` members.

What the pivots leave: nodes whose bucket still spans several components are compared where they share a shingle that
counts. A node's shingles are put in one order, rare ones first; two nodes whose similarity reaches SIMILAR share at least
2 SIMILAR / (1 + SIMILAR) of the lighter one's weight and SIMILAR of the heavier one's, so they have a common shingle among the first
of each, up to the rest of its weight (prefix filter). A template in many documents stands at the end of that order, behind what is a
document's own, and makes no pair. Only nodes of weights that can link meet there. No pair whose link could matter is left out, and none is made for a bucket's sake.

Bounds: two documents of weights w share at most the smaller of their v, where v leaves out what no other document still in
question has; so their similarity is at most m / (w + w - m) with m = min v. If both were compared with one pivot and share s with
it, what they share inside and outside the pivot is bounded apart: m = min s + min (v - s). Pairs below SIMILAR by that
are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SHINGLE, SIMILAR = 5, 0.8
#: A link of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**10 = 0.9992.
BANDS, ROWS = 10, 3
#: Share of documents from which on a shingle's frequency counts; most candidates that are sent to all tasks (8 bytes each).
COMMON, LEAST, SENT = 0.005, 0.001, 2_000_000
#: Members compared with a copy of their pivot in one task.
PART = 512
#: Shares of a node's weight that its first shingles make up, as the heavier and as the lighter of a pair; room for rounding.
HEAVIER, LIGHTER, EPS = 1 - SIMILAR, 1 - 2 * SIMILAR / (1 + SIMILAR), 1e-9
#: Width of a class of weights, in logarithms: a little more than two linked nodes may differ by.
CLASS = -math.log(SIMILAR - 1e-6)
#: Ids up to which they are sent to all tasks to pick candidates' texts (8 bytes each); beyond, texts are shuffled.
PICKED = 1_000_000
#: Documents worked on at a time.
CHUNK = 256
#: Bytes of a word up to which it is hashed along with all others; longer ones are hashed each.
LONG = 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Masks of the first bytes, 0 to 8, of a block.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    _mix_on(x, np.empty_like(x))
    return x


def _mix_on(x: np.ndarray, room: np.ndarray) -> None:
    """The steps of ``_mixed`` after its first product, in place; room: an array like x."""
    x ^= np.right_shift(x, np.uint64(32), out=room)
    x *= _ODD[1]
    x ^= np.right_shift(x, np.uint64(29), out=room)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of these large strings. All words at once, 8 bytes a step: a Python call a word costs more than all else here."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    _, offsets, raw = words.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    start, size = offsets[:-1], np.diff(offsets)
    data = np.zeros(int(offsets[-1]) + 8, dtype=np.uint8)
    if offsets[-1]:
        data[:-8] = np.frombuffer(raw, dtype=np.uint8, count=int(offsets[-1]))
    blocks = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # the 8 bytes from each place on
    out = _mixed(_mixed(size.astype(np.uint64)) ^ (blocks[start] & _BYTES[np.minimum(size, 8)]))
    left, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(left):
        out[left] = _mixed(out[left] ^ (blocks[start[left] + done] & _BYTES[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return out


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the distinct hashes of its shingles, sorted, and their counts."""
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(texts, pa.large_string())))
    stream = word_hashes(cut.values)
    n = len(stream) - SHINGLE + 1
    run = _mixed(sum(stream[i : n + i] * _ODD[i] for i in range(SHINGLE))) if n > 0 else stream[:0]
    offsets, found, none = cut.offsets.to_numpy().tolist(), [], np.zeros(0, dtype=np.uint64)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        if not text.strip():
            own = none
        elif b - a < SHINGLE:
            own = _mixed(sum((stream[a + i : a + i + 1] * _ODD[i] for i in range(b - a)), np.array([b - a], dtype=np.uint64)))
        else:
            own = np.sort(run[a : b - SHINGLE + 1])
        found.append(own)
    # of all texts at once: where a value differs from the one before it, or a text begins
    ends = np.cumsum([len(own) for own in found], dtype=np.int64)
    every = np.concatenate([none, *found])
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    new[ends[ends < len(every)]] = True
    at = np.flatnonzero(new)
    hashed, counts, ends = every[at], np.diff(at, append=len(every)), np.searchsorted(at, ends).tolist()
    return [(hashed[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


class Weights:
    """Weight of a shingle: its count times its inverse document frequency over the largest one."""

    def __init__(self, common: np.ndarray, factor: np.ndarray):
        order = np.argsort(common)
        self.common, self.factor = common[order], factor[order]
        self.rank = np.argsort(np.lexsort((self.common, -self.factor)))

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Of each common shingle its place by rising document frequency, -1 of others."""
        out = np.full(len(hashed), -1, dtype=np.int64)
        if len(self.common) and len(hashed):
            at = np.minimum(np.searchsorted(self.common, hashed), len(self.common) - 1)
            hit = self.common[at] == hashed
            out[hit] = self.rank[at[hit]]
        return out

    def of(self, hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = counts.astype(np.float64)
        if len(self.common) and len(hashed):
            at = np.minimum(np.searchsorted(self.common, hashed), len(self.common) - 1)
            hit = self.common[at] == hashed
            weight[hit] *= self.factor[at[hit]]
        return weight


def _gamma_quantiles(n: int) -> np.ndarray:
    """n quantiles of Gamma(2, 1), by bisection of its distribution 1 - exp(-x)(1 + x)."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Consistent weighted samples; the draws for a shingle and a hash come from 48 bits of their mixed number."""

    def __init__(self, hashes: int):
        self.r = _gamma_quantiles(1 << 16)
        self.ln_c = np.log(self.r)
        self.beta = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.beta_1 = self.beta - 1
        self.seeds = _mixed(np.arange(1, hashes + 1, dtype=np.uint64) * _ODD[4])

    def signatures(self, hashed: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each hash and document the smallest ln a, whose bits stand for the sample (shingle, t). starts: where documents begin."""
        out = np.empty((len(self.seeds), len(starts)))
        other = np.flatnonzero(weight != 1)  # of weight 1, t is 0
        ln_w = np.log(weight[other])
        # one set of arrays for all hashes: new ones would be taken from the system and given back at every step
        mixed, room, at = np.empty_like(hashed), np.empty_like(hashed), np.empty(len(hashed), dtype=np.intp)
        r, ln_a, ln_c = (np.empty(len(hashed)) for _ in range(3))
        for k, seed in enumerate(self.seeds):
            np.bitwise_xor(hashed, seed, out=mixed)
            mixed *= _ODD[0]
            _mix_on(mixed, room)
            draw = mixed.view(np.uint16).reshape(-1, 4)
            for column, (drawn, into) in enumerate(((self.r, r), (self.beta_1, ln_a), (self.ln_c, ln_c))):
                at[:] = draw[:, column]
                np.take(drawn, at, out=into, mode="wrap")  # no place lies outside; this mode takes without a copy
            # ln c - r (t - beta) - r, the part without t first, so that equal (shingle, t) have equal bits whatever the weights
            ln_a *= r
            ln_a += ln_c
            if len(other):
                ro = r[other]
                ln_a[other] -= ro * np.floor(ln_w / ro + self.beta[draw[other, 1]])
            out[k] = np.minimum.reduceat(ln_a, starts)
        return out


def common_weight(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight that two documents, as (sorted hashes, weights), share: the sum of the smaller weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    return float(np.minimum(a[1][hit], b[1][at[hit]]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; two documents without shingles are alike."""
    both = common_weight(a, b)
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[tuple[np.ndarray, np.ndarray]]]]:
    for i in range(0, len(batch), CHUNK):
        part = batch.iloc[i : i + CHUNK]
        yield part, shingles(part["_text"].tolist())


def common_shingles(spark: SparkSession, rows: DataFrame) -> Weights:
    """The factors of all shingles in at least COMMON of the rows (_id, _text), by exact counts over all of them."""
    total = rows.count()

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, []
        for batch in batches:
            for _, parts in _chunks(batch):
                n += len(parts)
                found += [h for h, _ in parts]
            if sum(map(len, found)) > 4_000_000:  # bounded memory: several counts a partition, each with its own threshold
                yield _frequent(found, n)
                n, found = 0, []
        if n:
            yield _frequent(found, n)

    def _frequent(found: list[np.ndarray], n: int) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"s": values[counts >= np.ceil(COMMON * n)].view(np.int64)})

    some = shared.table(spark, rows.select("_text").mapInPandas(candidates, "s long").distinct(), "common-candidates")
    if some.count() <= SENT:
        sent = spark.sparkContext.broadcast(np.sort(np.fromiter((r["s"] for r in some.toLocalIterator()), dtype=np.int64).view(np.uint64)))

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted = sent.value
            counts = np.zeros(len(wanted), dtype=np.int64)
            for batch in batches:
                for _, parts in _chunks(batch):
                    own = np.concatenate([h for h, _ in parts])
                    if len(own) and len(wanted):
                        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                        counts += np.bincount(at[wanted[at] == own], minlength=len(wanted))
            there = np.flatnonzero(counts)
            yield pd.DataFrame({"s": wanted[there].view(np.int64), "n": counts[there]})
    else:

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, parts in _chunks(batch):
                    values, counts = np.unique(np.concatenate([h for h, _ in parts]), return_counts=True)
                    yield pd.DataFrame({"s": values.view(np.int64), "n": counts})

    df = rows.select("_text").mapInPandas(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("df"))
    # a document has few shingles that 1 / COMMON of all others share: at most its length / COMMON rows
    found = df.where(F.col("df") >= COMMON * total).toPandas()
    factor = np.log((total + 1) / found["df"].to_numpy(dtype=float)) / np.log(1 / COMMON)
    return Weights(found["s"].to_numpy(dtype=np.int64).view(np.uint64), np.clip(factor, LEAST, 1.0))


def signed(spark: SparkSession, rows: DataFrame, weights: Weights) -> DataFrame:
    """Per row: _id, _set (digest of its shingles and counts), _w (its weight), _bands (a bucket number a band)."""
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared.sole()
        sampler, own = Sampler(BANDS * ROWS), sent.value
        salts = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[3])
        for batch in batches:
            for part, found in _chunks(batch):
                sets = [xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()) for h, c in found]
                full = [i for i, (h, _) in enumerate(found) if len(h)]
                bands, total = [np.zeros(0, dtype=np.int64)] * len(found), np.zeros(len(found))
                if full:
                    hashed, counts = (np.concatenate([found[i][x] for i in full]) for x in (0, 1))
                    sizes = np.array([len(found[i][0]) for i in full])
                    weight, starts = own.of(hashed, counts), np.cumsum(sizes) - sizes
                    total[full] = np.add.reduceat(weight, starts)
                    low = sampler.signatures(hashed, weight, starts).view(np.uint64).reshape(BANDS, ROWS, -1)
                    keys = _mixed(sum(low[:, j] * _ODD[j] for j in range(ROWS)) + salts[:, None]).view(np.int64)
                    for i, column in zip(full, keys.T):
                        bands[i] = column
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), "_set": sets, "_w": total, "_bands": bands})

    return rows.mapInPandas(run, "_id long, _set binary, _w double, _bands array<long>")


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """The pairs (a, b) with the weight x that their texts share and whether their similarity reaches SIMILAR. Every a meets its bs in parts of PART."""
    sent = spark.sparkContext.broadcast(weights)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_role"), F.col("b").alias("_id"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_role"), F.col("a").alias("_id"))
    rows = members.unionByName(pivots).join(texts, "_id").repartition("a", "_part").sortWithinPartitions("a", "_part", "_role", "_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key, pivot = sent.value, None, None
        for batch in batches:
            out = []
            for part, found in _chunks(batch):
                for a, p, role, i, (h, c) in zip(part["a"], part["_part"], part["_role"], part["_id"], found):
                    this = (h, own.of(h, c))
                    if role == 0:
                        key, pivot = (a, p), this
                    elif key == (a, p):
                        x = common_weight(pivot, this)
                        out.append((a, i, x, x >= SIMILAR * (pivot[1].sum() + this[1].sum() - x)))
            yield pd.DataFrame(out, columns=["a", "b", "x", "linked"])

    return rows.select("a", "_part", "_role", "_id", "_text").mapInPandas(run, "a long, b long, x double, linked boolean")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(_id, _root) for all ends of the edges (a, b): the smallest id of each connected component.

    Every node hooks to its smallest neighbour, chains are shortened by doubling, edges are drawn between roots,
    and so on until none is left. Only tables of ids are kept, on shared files.
    """
    found, left = None, shared.table(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = shared.table(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_id"), F.least("a", "m").alias("_root")), "hooks")
        while True:
            up = hook.select(F.col("_id").alias("_root"), F.col("_root").alias("_up"))
            nxt = shared.table(spark, hook.join(up, "_root").select("_id", F.col("_up").alias("_root"), (F.col("_up") != F.col("_root")).alias("_moved")), "hooks")
            moved = not nxt.where("_moved").isEmpty()
            hook = nxt.drop("_moved")
            if not moved:
                break
        to = hook.select(F.col("_id").alias("_root"), F.col("_root").alias("_to"))
        found = hook if found is None else found.join(to, "_root", "left").select("_id", F.coalesce("_to", "_root").alias("_root"))
        a, b = hook.select(F.col("_id").alias("a"), F.col("_root").alias("x")), hook.select(F.col("_id").alias("b"), F.col("_root").alias("y"))
        left = shared.table(spark, left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return found


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (smallest id of its class), class_size, kept (whether it has that id).

    Documents are in a class if links of similarity 0.8 or more lead from one to the other. Texts of any length are read whole. Null
    texts count as empty; texts without a word equal each other. Rows without an id stay alone with a null class and are kept. Rows that repeat
    an id are one document, whose text is the smallest of theirs; each of them has its class, and it counts once. An empty table gives an empty one; columns besides the two are not looked at.
    """
    shared.fresh(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    named = rows.where("_id IS NOT NULL")
    again = shared.table(spark, named.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"), "repeated-ids")
    single = again.isEmpty()
    if not single:
        named = named.join(again, "_id", "left_anti").unionByName(named.join(again, "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text")))
    weights = common_shingles(spark, named)
    signs = shared.table(spark, signed(spark, named, weights), "signatures")
    nodes = shared.table(spark, signs.groupBy("_set").agg(F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_m")), "nodes")
    buckets = signs.join(nodes.select(F.col("_node").alias("_id"), "_set"), ["_id", "_set"], "left_semi").select(F.col("_id").alias("n"), "_w", F.explode("_bands").alias("k")).groupBy("k", "n").agg(F.max("_w").alias("w"))
    # tables of their own, here and below: so a join can split a bucket that many nodes share
    many = shared.table(spark, buckets.groupBy("k").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("k"), "shared-buckets")
    buckets = shared.table(spark, buckets.join(many, "k", "left_semi"), "buckets")
    ids = buckets.select(F.col("n").alias("_id")).distinct()
    texts = shared.table(spark, named.join(F.broadcast(ids) if ids.count() <= PICKED else ids, "_id", "left_semi"), "candidate-texts")
    roots = links(spark, buckets, texts, weights)
    placed = shared.table(spark, nodes.join(roots.select(F.col("_id").alias("_node"), "_root"), "_node", "left").select("_set", "_m", F.coalesce("_root", "_node").alias("class_id")), "placed")
    # classes of several nodes get their size by a join of tables, which Spark can split where a class is large
    sizes = shared.table(spark, placed.groupBy("class_id").agg(F.sum("_m").alias("class_size"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("class_id", "class_size"), "class-sizes")
    sized = placed.join(sizes, "class_id", "left").select("_set", "class_id", F.coalesce("class_size", "_m").alias("class_size"))
    done = signs.select("_id", "_set").join(sized, "_set").select(F.col("_id").alias(id_col), "class_id", "class_size", (F.col("_id") == F.col("class_id")).alias("kept"))
    if not single:
        done = rows.select(F.col("_id").alias(id_col)).join(done, id_col)
    alone = rows.where("_id IS NULL").select(F.col("_id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return done.unionByName(alone)


def counted_shingles(spark: SparkSession, texts: DataFrame, weights: Weights) -> DataFrame:
    """(n, s, x, place): the shingles of the texts (_id, _text), their weights, and their place in an order that has rare ones first.

    The place of a shingle is the number of the texts that have it; common ones, which hot keys would be, are not counted but come
    after all others, by their document frequency.
    """
    sent = spark.sparkContext.broadcast(weights)
    last = 1 << 40

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            for part, found in _chunks(batch):
                n = np.repeat(part["_id"].to_numpy(), [len(h) for h, _ in found])
                h, c = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                place = own.places(h)
                yield pd.DataFrame({"n": n, "s": h.view(np.int64), "x": own.of(h, c), "place": np.where(place >= 0, last + place, 0)})

    rows = shared.table(spark, texts.mapInPandas(run, "n long, s long, x double, place long"), "shingles")
    rare = rows.where("place = 0").withColumn("place", F.count(F.lit(1)).over(Window.partitionBy("s")))
    return shared.table(spark, rare.unionByName(rows.where("place > 0")), "counted-shingles")


def prefix_pairs(counted: DataFrame, known: DataFrame, possible, other: list) -> DataFrame:
    """(a, b) of nodes of different components (n, w, c, ...) that may be linked: each pair once, the lighter one as a.

    ``counted``: the shingles of the nodes at least. ``possible`` holds a pair's bound against what is needed.
    """
    order = Window.partitionBy("n").orderBy("place", "s").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.join(known.select("n", "w"), "n").withColumn("before", F.coalesce(F.sum("x").over(order), F.lit(0.0))).where((F.col("place") > 1) & (F.col("before") <= HEAVIER * F.col("w") + EPS))
    # weights within a factor of SIMILAR lie in one class or in neighbouring ones
    size = F.floor(F.log("w") / CLASS).cast("int")
    held = first.select("n", "s", "before").join(known, "n")
    lighter = held.where(F.col("before") <= LIGHTER * F.col("w") + EPS).select("s", size.alias("q"), F.col("n").alias("a"), F.col("c").alias("d"), *other)
    heavier = held.drop("before").withColumnRenamed("n", "b").withColumn("q", F.explode(F.array(size - 1, size)))
    after = (F.col("w") > F.col("pw")) | (F.col("w") == F.col("pw")) & (F.col("b") > F.col("a"))
    return lighter.join(heavier, ["s", "q"]).where(after & (F.col("c") != F.col("d")) & possible).select("a", "b").distinct()


def open_buckets(spark: SparkSession, placed: DataFrame) -> tuple[DataFrame, float]:
    """The rows of buckets whose nodes are in several components (c), and the number of pairs between these."""
    sizes = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("k")
    split = sizes.agg(F.count(F.lit(1)).alias("parts"), ((F.pow(F.sum("m"), F.lit(2)) - F.sum(F.pow("m", F.lit(2)))) / 2).alias("pairs")).where("parts > 1")
    split = shared.table(spark, split.select("k", "pairs"), "open-buckets")
    return shared.table(spark, placed.join(split.select("k"), "k"), "live-buckets"), split.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def links(spark: SparkSession, buckets: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """Components (_id, _root) of the links between nodes that share a bucket (k, n, and w, the node's weight)."""
    edges = spark.createDataFrame([], "a long, b long")
    done = edges  # pairs that were compared, linked or not
    roots = edges.select(F.col("a").alias("_id"), F.col("b").alias("_root"))
    # v: weight that others may share; p, s: a pivot the node was compared with, and the weight they share
    known = buckets.select("n", "w", F.col("w").alias("v"), F.lit(None).cast("long").alias("p"), F.lit(0.0).alias("s")).distinct()
    buckets, counted = buckets.select("k", "n"), None
    most = F.least("v", "pv")
    most = F.when(F.col("p") == F.col("pp"), F.least(most, F.least("s_", "ps") + F.least(F.col("v") - F.col("s_"), F.col("pv") - F.col("ps")))).otherwise(most)
    possible = most >= SIMILAR * (F.col("w") + F.col("pw") - most) - EPS
    other = [F.col("w").alias("pw"), F.col("v").alias("pv"), F.col("p").alias("pp"), F.col("s_").alias("ps")]

    def placed() -> DataFrame:
        root = roots.select(F.col("_id").alias("n"), "_root")
        return buckets.join(known, "n").join(root, "n", "left").select("k", "n", "w", "v", "p", F.col("s").alias("s_"), F.coalesce("_root", "n").alias("c"))

    for turn in range(3):
        live, across = open_buckets(spark, placed())
        if turn == 1 and across:  # what the nodes still in question share at most; those with too little have no partner
            ids = live.select(F.col("n").alias("_id")).distinct()
            counted = counted_shingles(spark, texts.join(ids, "_id", "left_semi"), weights)
            alone = counted.where("place = 1").groupBy("n").agg(F.sum("x").alias("alone"))
            share = F.col("w") - F.coalesce("alone", F.lit(0.0))
            known = shared.table(spark, live.select("n", "w").distinct().join(alone, "n", "left").select("n", "w", share.alias("v"), F.lit(None).cast("long").alias("p"), F.lit(0.0).alias("s")).where(F.col("v") >= SIMILAR * F.col("w") - EPS), "known")
            buckets = live.select("k", "n")
            live, across = open_buckets(spark, placed())
        if not across:
            break
        if turn == 2:
            pairs = prefix_pairs(counted, live.drop("k").distinct(), possible, other)
        else:
            order = F.struct((-F.col("v") / F.col("w")).alias("o"), F.xxhash64("n", F.lit(turn)).alias("h")) if turn == 1 else F.struct(F.xxhash64("n", F.lit(turn)).alias("o"))
            pivots = live.groupBy("k").agg(F.min(F.struct(order.alias("o"), F.col("n").alias("a"))).alias("m")).select("k", "m.a")
            pivots = shared.table(spark, pivots, "pivots")
            # the pivots of turn 1 serve the bounds: all are held to them
            pairs = live.select("k", "n").join(pivots, "k").where(F.col("n") != F.col("a")).select("a", F.col("n").alias("b")).distinct()
        if turn == 2:
            both = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(both, ["a", "b"], "left_anti")
        seen = shared.table(spark, verified(spark, shared.table(spark, pairs, "pairs"), texts, weights), "compared")
        edges, done = edges.unionByName(seen.where("linked").select("a", "b")), done.unionByName(seen.select("a", "b"))
        if turn == 1:
            own = seen.select(F.col("a").alias("n")).distinct().join(known, "n").select("n", F.col("n").alias("_p"), F.col("w").alias("_s"))
            met = seen.select(F.col("b").alias("n"), F.col("a").alias("_p"), F.col("x").alias("_s")).unionByName(own)
            size = seen.groupBy(F.col("a").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
            # of several pivots the one that most were held to, so that the nodes of a group have the same
            best = met.join(size, "_p").groupBy("n").agg(F.max(F.struct("_c", "_p", "_s")).alias("_m"))
            known = shared.table(spark, known.join(best, "n", "left").select("n", "w", "v", F.col("_m._p").alias("p"), F.coalesce("_m._s", F.lit(0.0)).alias("s")), "known")
        if not seen.where("linked").isEmpty():
            roots = shared.table(spark, components(spark, edges), "roots")
    return roots


def kept_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns, whatever their names."""
    (gone,) = shared.unused(docs, "_gone")
    out = shared.table(spark, classes(spark, docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(gone)).distinct(), "near-copies")
    return docs.join(out, docs[id_col] == out[gone], "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
