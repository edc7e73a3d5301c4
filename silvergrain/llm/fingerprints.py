"""Document fingerprints by winnowing, in DataFrame operations only.

A k-gram's hash is a polynomial, modulo 2^31, of the hashes of its pieces of ``STEP`` bytes. Each place's piece is hashed once by a built-in function
and serves the k-grams that begin and that end with it; so the hash rolls by pieces, not by bytes. A roll by bytes, in arrays by doubling (1, 2, 4, 8 and 12
bytes), gives as good prints for half as much time again and does not fit the budget of CPU seconds. Of each window of w neighbouring k-grams the
smallest hash is chosen, the rightmost of equal ones, and its position is kept. So any stretch of at least w + k - 1 bytes that two texts share gives
them a common fingerprint, whatever stands around it.

A k-gram's hash and place are one number: the hash above, the place below and counted backwards, so the smallest number of
a window is the rightmost smallest hash. Minima over 2, 4 and 8 neighbours come by doubling, those of a whole
window from three of 8; a text's cost is linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Bytes of a k-gram; k-grams of a window, three times 8: shared stretches of 35 bytes are always found.
GRAM, WINDOW = 12, 24
#: Bytes of a piece, of which a k-gram has two; the polynomial's base, and the bits that it is taken modulo 2^31 by.
STEP, BASE, MASK = 6, 48271, (1 << 31) - 1
#: A number's lower 31 bits hold the place, counted backwards from here.
LAST = (1 << 31) - 1
#: Ranges of ids by percentiles in two steps, for finding a row's successor without one global sort: cells, bytes of text in a range, most ranges of a cell.
SPLITS, RANGE_BYTES, MOST_PARTS = 64, 1 << 20, 1 << 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, not wherever body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def chosen(data: Column, before: Column | None = None) -> Column:
    """Fingerprint numbers of a text's bytes in order of place, each once. ``before``: bytes that precede it, added to places.

    A text with fewer k-grams than a window is one window, one shorter than a k-gram is one gram, an empty one has none.
    """
    last = F.lit(LAST - 1).cast("long") if before is None else LAST - 1 - before.cast("long")
    none = F.array().cast("array<bigint>")

    def pieces(data: Column) -> Column:
        """Hash of the STEP bytes from each place on; of fewer at the end of a text that is shorter than a k-gram."""
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(data) - STEP + 1, F.lit(GRAM - STEP + 1)))
        return F.when(F.octet_length(data) > 0, F.transform(places, lambda i: F.hash(F.substring(data, i, F.lit(STEP))).cast("long"))).otherwise(none)

    def grams(p: Column) -> Column:
        rolled = lambda x, i: (x * BASE + F.get(p, i + STEP)).bitwiseAND(F.lit(MASK))
        number = lambda x, i: F.shiftleft(rolled(x, i), 31) + (last - i)
        return F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - GRAM + STEP, F.lit(0))), number)

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda m: F.zip_with(m, F.slice(m, F.lit(step + 1), F.size(m)), lambda a, b: F.least(a, b))

    def windows(m: Column) -> Column:
        own = F.slice(m, F.lit(1), F.greatest(F.size(m) - WINDOW + 1, F.least(F.size(m), F.lit(1))))
        return F.transform(own, lambda x, i: F.least(x, F.get(m, i + 8), F.get(m, i + 16)))

    eights = let(let(let(let(let(data, pieces), grams), doubled(1)), doubled(2)), doubled(4))
    return F.array_distinct(let(eights, windows))


def place(number: Column) -> Column:
    """1-based byte at which the k-gram starts."""
    return F.lit(LAST) - number.bitwiseAND(F.lit(LAST))


def hashes(numbers: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(numbers, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sets of hashes, 0 to 1; two empty ones are alike."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def written(hashed: Column) -> Column:
    """A fingerprint as text: eight hex digits a hash, in order."""
    return F.array_join(F.transform(hashed, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, prints (array of hash and place in bytes), in order of place.

    Null counts as empty, which has no prints; texts of any length, up to 2 GB, are read whole. Of equal hashes in a window the
    rightmost is chosen. Rows that repeat have equal prints. Columns besides the two are not looked
    at. An empty table gives an empty one.
    """
    shared.fresh(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), chosen(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("_n"))
    return rows.select("doc_id", F.transform("_n", lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("hash"), place(x).cast("int").alias("place"))).alias("prints"))


def edited(head: Column, tail: Column, numbers: Column) -> Column:
    """Fingerprint numbers of head + tail, where ``numbers`` are those of a text that begins with head.

    Windows inside head choose as they did; only the windows that reach its end are computed.
    """
    last = F.octet_length(head) - WINDOW - GRAM + 2  # of the windows inside head, the last one's first place
    begin = F.greatest(last - WINDOW + 1, F.lit(1))

    own = F.filter(numbers, lambda x: place(x) <= last)
    # bytes of head from ``begin`` on, as binary: a cut may fall inside a code point
    rest = F.concat(F.substring(F.encode(head, "utf-8"), begin, F.greatest(F.octet_length(head), F.lit(1))), F.encode(tail, "utf-8"))
    return F.array_union(own, chosen(rest, begin - 1))


def ranges(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What adds ``_range`` to rows (_id, _text): numbers that fall with the order of ids, about RANGE_BYTES of text each.

    Cells are percentiles of ids, and the ranges of a cell are percentiles of its ids, so both hold equal counts however far apart ids lie.
    Rows without an id come behind all others, in equal ranges of a hash of their texts.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.percentile_approx("_id", [i / SPLITS for i in range(1, SPLITS)], 10_000).alias("q"), F.sum(F.octet_length("_text")).alias("bytes"), F.sum(F.when(F.col("_id").isNull(), F.octet_length("_text"))).alias("lost")).first()
    count = lambda size: max(1, min(MOST_PARTS, -(-(size or 0) // RANGE_BYTES)))
    parts, lost = count((seen["bytes"] or 0) // SPLITS), count(seen["lost"])
    edges = sorted(set(seen["q"] or []))

    def cell(lo: int, hi: int) -> Column:
        """How many of edges[lo:hi] are at or below the id, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_id") < F.lit(edges[mid]), cell(lo, mid)).otherwise(cell(mid + 1, hi))

    celled = lambda df: df.withColumn("_cell", cell(0, len(edges)))
    fine = celled(rows.select("_id").where("_id IS NOT NULL")).groupBy("_cell").agg(F.array_distinct(F.percentile_approx("_id", [i / parts for i in range(1, parts)] or [1.0], 10_000)).alias("_edges"))
    held = fine.collect()  # SPLITS rows of at most MOST_PARTS ids
    sent = F.broadcast(spark.createDataFrame([(r["_cell"], r["_edges"]) for r in held], "_cell int, _edges array<long>"))
    # the place of the id among its cell's edges
    part = F.size(F.filter("_edges", lambda e: e <= F.col("_id"))) if parts > 1 else F.lit(0)
    behind = -1 - F.floor((F.shiftright(F.xxhash64("_text"), 32) + (1 << 31)) * lost / (1 << 32))
    number = F.when(F.col("_id").isNull(), behind).otherwise(F.col("_cell").cast("long") * (MOST_PARTS + 1) + part)
    return lambda df: celled(df).join(sent, "_cell", "left").withColumn("_range", number.cast("long")).drop("_cell", "_edges")


def successors(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (_id, _text) with _prints, and _next_text and _next_prints of the row that follows by descending id.

    After the last comes the first. Rows of one id are ordered by a hash of their texts; rows without id come last. Ids are
    cut into ranges; each range is sorted by itself and gets a copy of the first row of the next one, so nothing is sorted
    in one task.
    """
    ranged = ranges(rows)(rows)
    place = F.struct("_id", F.bitwise_not(F.xxhash64("_text")).alias("h"))  # the greatest of a range comes first
    tops = ranged.groupBy("_range").agg(F.max(place).alias("_top"))  # a row a range
    down = Window.orderBy(F.desc("_range"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = tops.select(F.col("_range").alias("_from"), "_top", F.coalesce(F.lag("_range").over(down), F.min("_range").over(whole)).alias("_range"))
    ghosts = ranged.withColumnRenamed("_range", "_from").join(F.broadcast(to), "_from").where(place.eqNullSafe(F.col("_top"))).select("_id", "_text", "_range", F.lit(1).alias("_ghost"))
    order = Window.partitionBy("_range").orderBy("_ghost", F.desc_nulls_last("_id"), F.xxhash64("_text"))
    # texts are shuffled without their prints, which take as much room again
    both = ranged.select("_id", "_text", "_range", F.lit(0).alias("_ghost")).unionByName(ghosts).repartition("_range").withColumn("_prints", chosen(F.encode("_text", "utf-8")))
    return both.select("*", F.lead("_text").over(order).alias("_next_text"), F.lead("_prints").over(order).alias("_next_prints")).where("_ghost = 0").drop("_ghost", "_range")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = successors(spark, docs)
    third = F.floor(F.length("_text") / 3).cast("int")
    cut = rows.withColumn("_head", F.left("_text", F.length("_text") - third)).withColumn("_tail", F.left("_next_text", third))
    done = cut.select("*", edited(F.col("_head"), F.col("_tail"), F.col("_prints")).alias("_edited"))
    hashed = done.select("*", hashes(F.col("_prints")).alias("_a"), hashes(F.col("_edited")).alias("_b"), hashes(F.col("_next_prints")).alias("_c"))
    return hashed.select(
        F.col("_id").alias("doc_id"), F.length("_text").cast("long").alias("n_chars"), F.sha2(F.concat("_head", "_tail"), 256).alias("edited_sha256"),
        written(F.col("_a")).alias("fingerprint"), written(F.col("_b")).alias("edited_fingerprint"), likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
