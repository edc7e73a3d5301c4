"""Suffix-array dedup of long repeated byte strings: blockwise suffix sorting with difference-cover ranks.

A byte goes if a string of LENGTH bytes that covers it starts at two places or more. Sorting all suffixes finds such
strings as neighbours with a common prefix of LENGTH. They need not be sorted together: the suffixes are
split into buckets that share no such string, and one block of buckets is sorted at a time.

Splitting: among the GRAM-byte strings inside a suffix's first LENGTH bytes, the one of the smallest hash (the first of equal
ones) is its anchor. Equal strings have equal anchors at equal distances, so a bucket is an anchor's hash and the distance.
Suffixes whose anchor occurs once in all texts repeat nowhere and are not sorted; neighbouring starts with one
anchor travel as one segment, and equal segments as one with a number of copies.

Sorting a block: its segments are laid out with the anchors at multiples of the cover's period v. The suffixes at
positions in the difference cover D (mod v), a share of |D| / v, are ranked to the full depth. All suffixes are then sorted by
bucket and their first v bytes; ties, of which long repeats have many, are resolved by the ranks of the cover samples at
the next position of D, at most v bytes on, instead of reading on. Neighbours in that order that agree in LENGTH bytes repeat.

Buckets of more than HOT different segments, such as the edges of a passage that a large share of all documents holds, would
not fit one task. They are split by the next bytes: the distances of a bucket are halved, each half's segments are cut to what its
suffixes hold, merged where they are equal by now, and told apart by the bytes that all suffixes of the half share, which are more
the shorter its range is. Halving ends where a part fits; a range of one distance is told apart by the whole string. Every part is sorted.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM = 200, 48
#: Different segments in a bucket up to which it is sorted in one task; bytes of the segments sorted at a time; bytes of texts hashed at a time.
HOT, BLOCK, CHUNK = 8192, 2 << 20, 1 << 20
#: Bits that a place takes below the hash that anchors are chosen by: more than the bytes hashed together, CHUNK and a text of 2 GB, need.
PLACE_BITS = 32
#: Size of the difference cover: period 24 r r + 36 r + 13, 6 r + 4 members.
COVER = 1

_LUT = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), dtype=np.uint64)
_M = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def difference_cover(r: int = COVER) -> tuple[int, list[int]]:
    """Period and members: every difference modulo the period is one of two members (steps after Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    members = np.concatenate([[0], np.cumsum(steps)]).tolist()
    return 24 * r * r + 36 * r + 13, members


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 18))
        one, back = np.full(size, _M, dtype=np.uint64), np.full(size, pow(_M, -1, 1 << 64), dtype=np.uint64)
        one[0] = back[0] = 1
        _POWERS[:] = [np.multiply.accumulate(one), np.multiply.accumulate(back)]
    return _POWERS[0][:n], _POWERS[1][:n]


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts with one anchor: text number, first start, last start, anchor (all in the text), hash of the anchor."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, none
    power, back = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LUT[data] * power, out=sums[1:])
    grams = n - GRAM + 1
    h = (sums[GRAM:] - sums[:grams]) * back[:grams]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # as many bits of the hash for every text, so that equal strings have equal anchors wherever they stand; of ties the leftmost
    low = np.uint64((1 << PLACE_BITS) - 1)
    order = (h & ~low) | np.arange(grams, dtype=np.uint64)
    span = LENGTH - GRAM + 1
    pad = -grams % span
    blocks = np.concatenate([order, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    anchor = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = np.flatnonzero(text[:starts] == text[LENGTH - 1 : LENGTH - 1 + starts])
    if not len(inside):
        return none, none, none, none, none
    at = anchor[inside]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    own = text[inside[first]].astype(np.int64)
    begin = (np.cumsum(sizes) - sizes)[own]
    return own, inside[first] - begin, inside[last] - begin, at[first] - begin, h[at[first]].view(np.int64)


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= CHUNK:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _refined(group: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then key; and the new group numbers in that order (a number is its group's first place)."""
    found = np.lexsort((key, group))
    g, k = group[found], key[found]
    new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]
    return order[found], np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))


def _sorted_by_words(word, order: np.ndarray, group: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort by the bytes from begin to end, eight at a time; only what still ties is looked at again.

    order: positions, so far sorted; group: for each place, the first place of its ties.
    """
    for at in range(begin, end, 8):
        size = np.bincount(group, minlength=len(group) + 1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        positions, local = _refined(group[tied], word(order[tied] + at), order[tied])
        order[tied], group[tied] = positions, tied[local]
    return order, group


def repeated(segments: list[bytes], anchors: list[int], buckets: list[int], last: list[int]) -> list[np.ndarray]:
    """For each segment, which of its starts 0..last have LENGTH bytes that some other start of the block has too.

    anchors: place of the anchor in each segment; buckets: its hash. Suffixes of one anchor and distance are one bucket.
    """
    v, members = difference_cover()
    inverse = np.full(v, v, dtype=np.int64)  # to the next member of the cover
    for delta in range(v - 1, -1, -1):
        for d in members:
            inverse[(d - delta) % v] = delta
    parts, place, at = [], [], 0
    for s, a in zip(segments, anchors):
        gap = -(at + a) % v
        parts += [bytes(gap), s]
        place.append(at + gap)
        at += gap + len(s)
    data = np.frombuffer(b"".join(parts) + bytes(2 * LENGTH + v + 16), dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), shape=(len(data) - 7,), strides=(1,))
    word = lambda p: words[p].astype(np.uint64)
    counts, place = np.array(last) + 1, np.array(place)
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    position = place[owner] + offset
    # the buckets: anchor and distance to it
    _, number = np.unique(np.array(buckets, dtype=np.int64), return_inverse=True)
    bucket = number[owner] * (LENGTH + 1) + (np.array(anchors)[owner] - offset)
    order, group = _refined(np.zeros(total, dtype=np.int64), bucket, np.arange(total))
    # cover samples that a tie can ask for, ranked to the full depth
    depth = -(-v // 8) * 8
    step = inverse[position % v]
    sample = np.unique(position + step)
    s_order, s_group = _sorted_by_words(word, sample.copy(), np.zeros(len(sample), dtype=np.int64), 0, LENGTH)
    rank = np.zeros(len(data), dtype=np.int32)
    rank[s_order] = s_group
    # all suffixes by their first bytes, then ties by the ranks
    place_order, group = _sorted_by_words(word, position[order], group, 0, depth)
    back = np.zeros(len(data), dtype=np.int64)
    back[position] = np.arange(total)
    order = back[place_order]
    size = np.bincount(group, minlength=total + 1)
    tied = np.flatnonzero(size[group] > 1)
    if len(tied):
        own = order[tied]
        found, _ = _refined(group[tied], rank[position[own] + step[own]].astype(np.int64), own)
        order[tied] = found
    # neighbours of one bucket that agree in LENGTH bytes
    pair = np.flatnonzero(group[1:] == group[:-1])
    left, right = position[order[pair]], position[order[pair + 1]]
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same = words[left + at] == words[right + at]
        pair, left, right = pair[same], left[same], right[same]
    flag = np.zeros(total, dtype=bool)
    flag[order[pair]] = flag[order[pair + 1]] = True
    return np.split(flag, np.cumsum(counts)[:-1])


def _ranges(flag: np.ndarray) -> list[int]:
    """First and last index of each run of true, one after the other."""
    edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
    edge[1::2] -= 1
    return edge.tolist()


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8") for t in texts]


def halved(level: DataFrame) -> DataFrame:
    """Segments (key, h, content, more, anchor, copies, lo, hi) cut at the middle of their bucket's distances lo to hi.

    A row for each half in which a segment has a start: key, shift (of its first start), sub (digest of what it is now) and the
    columns of the cut segment, whose bucket h is that of the bytes that all strings of the half hold.
    """
    middle = F.expr("div(lo + hi + 1, 2)").cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), (middle - 1).alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    rows = level.select("key", "h", "content", "more", "anchor", "copies", F.explode(halves).alias("r"))
    # a start i has the distance anchor - i, so distances fall as starts rise
    first = (F.col("anchor") - F.least("anchor", "r.hi")).alias("shift")
    last = (F.col("anchor") - F.greatest(F.col("anchor") - F.col("more"), F.col("r.lo"))).alias("_last")
    rows = rows.select("*", first, last).where("_last >= shift")
    shared_bytes = F.substring("content", F.col("anchor") - F.col("r.lo") + 1, F.col("r.lo") + F.lit(LENGTH) - F.col("r.hi"))
    cut = rows.select(
        "key", "copies", "shift", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), (F.col("_last") - F.col("shift")).alias("more"), (F.col("anchor") - F.col("shift")).alias("anchor"),
        F.substring("content", F.col("shift") + 1, F.col("_last") - F.col("shift") + F.lit(LENGTH)).alias("content"), F.xxhash64("h", "r.lo", "r.hi", shared_bytes).alias("h"),
    )
    return cut.withColumn("sub", F.unhex(F.md5(F.concat("content", F.encode(F.concat_ws(",", "anchor", "lo", "hi"), "utf-8")))))


def spans(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (_id, _text), ids distinct: the texts that hold candidates (_id, _text), and their repeats (_id, first start, last start)."""

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = _bytes(batch["_text"]), batch["_id"].to_numpy()
            for a, b in chunks([len(t) for t in texts]):
                own, _, _, anchor, h = runs(texts[a:b])
                yield pd.DataFrame({"_id": ids[a:b][own], "h": h, "anchor": anchor.astype(np.int32)})

    anchors = shared.table(spark, rows.mapInPandas(anchored, "_id long, h long, anchor int"), "anchors")
    # a table of its own, so that the join with it can split an anchor that many texts have
    twice = shared.table(spark, anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-anchors")
    wanted = anchors.join(twice, "h").groupBy("_id").agg(F.collect_list("anchor").alias("_anchors"))
    texts = shared.table(spark, rows.join(wanted, "_id"), "repeat-candidates")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            data, ids, marked = _bytes(batch["_text"]), batch["_id"].tolist(), batch["_anchors"].tolist()
            for a, b in chunks([len(t) for t in data]):
                out = []
                held = [set(map(int, m)) for m in marked[a:b]]
                for own, first, last, anchor, h in zip(*(x.tolist() for x in runs(data[a:b]))):
                    if anchor in held[own]:
                        content = data[a + own][first : last + LENGTH]
                        key = xxhash.xxh3_128_digest(content)
                        out.append((ids[a + own], first, last - first, anchor - first, h, key, None if key in seen else content))
                        seen.add(key)
                if len(seen) > 500_000:
                    seen.clear()
                yield pd.DataFrame(out, columns=["_id", "first", "more", "anchor", "h", "key", "content"])

    parts = shared.table(spark, texts.mapInPandas(cut, "_id long, first int, more int, anchor int, h long, key binary, content binary"), "segments")
    copies = parts.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("content").alias("content"), F.max("h").alias("h"), F.max("more").alias("more"), F.max("anchor").alias("anchor"))
    different = shared.table(spark, copies, "different-segments")
    level = different.select("key", "h", "content", "more", "anchor", "copies", F.lit(0).alias("lo"), F.lit(LENGTH - GRAM).alias("hi"))
    sorted_parts, whole, moved = [], [], None  # moved: (key, sub, shift), where the starts of a segment's cuts are in it
    for depth in range(LENGTH.bit_length() + 1):
        crowds = shared.table(spark, level.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowds")
        sorted_parts.append(level.join(crowds.where(F.col("n") <= HOT).select("h"), "h", "left_semi").select("h", "content", "more", "anchor", "key", F.lit(depth > 0).alias("cut")))
        whole.append(level.where("copies > 1").select("key", F.array(F.lit(0), F.col("more")).alias("ranges"), F.lit(depth > 0).alias("cut")))
        hot = crowds.where(F.col("n") > HOT).select("h")
        if hot.isEmpty():
            break
        cuts = shared.table(spark, halved(level.join(hot, "h", "left_semi")), "cuts")
        level = shared.table(spark, cuts.groupBy(F.col("sub").alias("key")).agg(*(F.max(c).alias(c) for c in ("h", "content", "more", "anchor", "lo", "hi")), F.sum("copies").alias("copies")), "cut-segments")
        steps = cuts.select("key", "sub", "shift")
        if moved is None:
            made = steps
        else:
            made = moved.where(F.col("depth") == depth).select(F.col("key").alias("_key"), F.col("sub").alias("key"), F.col("shift").alias("_shift")).join(steps, "key").select(F.col("_key").alias("key"), "sub", (F.col("_shift") + F.col("shift")).alias("shift"))
        made = shared.table(spark, made.withColumn("depth", F.lit(depth + 1)), "moved")
        moved = made if moved is None else moved.unionByName(made)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, bucket = [], 0, None

        def done() -> pd.DataFrame:
            flags = repeated([bytes(x[1]) for x in held], [x[3] for x in held], [x[0] for x in held], [x[2] for x in held])
            return pd.DataFrame([(x[4], x[5], _ranges(f)) for x, f in zip(held, flags) if f.any()], columns=["key", "cut", "ranges"])

        for batch in batches:
            for row in zip(batch["h"].tolist(), batch["content"], batch["more"].tolist(), batch["anchor"].tolist(), batch["key"], batch["cut"].tolist()):
                if size >= BLOCK and row[0] != bucket:  # buckets stay whole
                    yield done()
                    held, size = [], 0
                bucket = row[0]
                held.append(row)
                size += len(row[1])
        if held:
            yield done()

    few, same = functools.reduce(DataFrame.unionByName, sorted_parts), functools.reduce(DataFrame.unionByName, whole)
    found = few.repartition("h").sortWithinPartitions("h", "key").mapInPandas(blocks, "key binary, cut boolean, ranges array<int>")
    flags = same.select("key", "cut", "ranges").unionByName(found.join(same.select("key"), "key", "left_anti"))
    if moved is None:
        flags = flags.select("key", "ranges")
    else:
        flags = shared.table(spark, flags, "flags")
        back = moved.join(flags.where("cut").select(F.col("key").alias("sub"), "ranges"), "sub").select("key", F.transform("ranges", lambda r: r + F.col("shift")).alias("ranges"))
        flags = flags.where("NOT cut").select("key", "ranges").unionByName(back)
    hits = parts.select("_id", "first", "key").join(flags, "key")
    at = lambda i: F.col("first") + F.get("ranges", i)
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("ranges"), 1) - 1), lambda i: F.struct(at(F.shiftleft(i, 1)).alias("a"), at(F.shiftleft(i, 1) + 1).alias("b")))
    return texts.select("_id", "_text"), hits.select("_id", F.explode(pairs).alias("r")).select("_id", "r.a", "r.b")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [start, end), sorted."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.r_[new[1:] - 1, len(s) - 1]].tolist()))


def _trimmed(spark: SparkSession, rows: DataFrame, schema: str, row) -> DataFrame:
    """row(text bytes, spans) for each text with repeats."""
    texts, hits = spans(spark, rows)
    lists = hits.groupBy("_id").agg(F.collect_list(F.struct("a", "b")).alias("_hits")).select("_id", F.transform("_hits", lambda h: h["a"]).alias("_a"), F.transform("_hits", lambda h: h["b"]).alias("_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *row(t.encode("utf-8"), merged(np.asarray(a), np.asarray(b) + LENGTH))) for i, t, a, b in zip(batch["_id"], batch["_text"], batch["_a"], batch["_b"])]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return shared.table(spark, texts.join(lists, "_id").mapInPandas(run, schema), "trimmed")


def kept_bytes(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for c in cut for x in c), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _numbered(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame]:
    """docs with a column that tells rows apart, its name, which no column of docs has, and (_id, _text): the id itself unless it repeats or is null."""
    shared.fresh(docs, id_col, text_col)
    (own,) = shared.unused(docs, "_id")
    if docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        named = docs.withColumn(own, F.col(id_col).cast("long"))
    else:
        named = shared.table(spark, docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    return named, own, named.select(F.col(own).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as empty; texts under LENGTH bytes lose nothing, those of any length are read whole. Rows that repeat are judged each, and lose all that
    LENGTH bytes cover. An empty table gives an empty one; columns besides the two are not looked at.
    """
    named, _, rows = _numbered(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")

    def row(data: bytes, cut: list[tuple[int, int]]) -> tuple:
        return sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept_bytes(data, cut)).hexdigest()

    lost = _trimmed(spark, rows, "_id long, n_removed long, n_spans long, sha string", row)
    text = F.coalesce("text", F.lit(""))
    base = named.select("_id", F.col("doc_id").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    return base.join(lost, "_id", "left").select(id_col, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "_whole").alias("kept_sha256"))


def trimmed_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of the text; a code point cut in two goes whole. Other columns stay, whatever their names."""
    named, own, rows = _numbered(spark, docs, id_col, text_col)
    (left,) = shared.unused(named, "_kept")
    done = _trimmed(spark, rows, "_id long, kept string", lambda data, cut: (kept_bytes(data, cut).decode("utf-8", "ignore"),))
    held = named.join(done.select(F.col("_id").alias(own), F.col("kept").alias(left)), own, "left")
    return held.select(*(F.coalesce(left, c).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
