"""Repair of the structure of conversations: which turns stay, change their role or go, and what is put in between.

A conversation is whole when the initials of its roles read ``(s?(ua)+)?``. Keeping a turn is free, a new role costs 2, a deletion 3,
an inserted empty turn 2; blank and duplicate turns must go, and a truncated one that stays costs 1 more.

A retained-subsequence programme: only turns that stay (kept or with a new role) are states, told apart by the role they
end with. What lies between two of them is deleted, at the difference of two prefix sums of deletions, so the best predecessor
of each role is a running minimum of cost less prefix sum; the pair of roles says how many turns must be inserted. Of equal costs
the audit (initials of the edits in order) that sorts first wins. Equal costs up to the same turn never have one audit begin the other, as
the longer would hold more insertions only; so the order of audits is kept by whatever follows, and minima may be taken on the way.
For the same reason the insertions of a gap stand behind its deletions.

Scale: turns are range-partitioned by conversation and order, so that a conversation of a third of all turns lies on many tasks.
Each chunk of at most CHUNK turns becomes a table of (role before, role after) -> (cost, audit), and those compose; only
these summaries meet by conversation. Duplicates are what is not the first place of its (conversation, role, text), found by a minimum
that combines before the shuffle and joined by place, which no two rows share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Bits of a place that number the turns of a chunk: 4096 turns at most.
CHUNK_BITS = 12
#: Characters of a text that tell rows of one turn apart when they are dealt to tasks.
PREFIX = 64
#: What a turn ends with ("" before the first), and the turns to insert for the next one's role, or for the end.
STATES = ("", "s", "u", "a")
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
AT_END = {"": 0, "s": 2, "u": 1, "a": 0}
ROLES = {"u": "user", "a": "assistant"}
#: A turn's code: its initial (o: any other), as a capital if truncated, as a digit if it must go.
PLAIN, CUT, GONE = "suao", "SUAO", "0123"
LEGAL = {"su", "ua", "au"}


class _Best:
    """The cheapest way to end with a state: cost less the prefix sum of deletions, and the audit, up to turn ``at``."""

    __slots__ = ("value", "audit", "at")

    def __init__(self, value: int, audit: str, at: int):
        self.value, self.audit, self.at = value, audit, at

    def until(self, turn: int) -> str:
        return self.audit + "D" * (turn - self.at)


def retained(codes: str, before: str) -> dict[str, tuple[int, str]]:
    """From the state before a chunk: each state it may end with, with cost and audit."""
    best = {before: _Best(0, "", 0)}
    for j, code in enumerate(codes, 1):
        if code in GONE:
            continue
        own = PLAIN[CUT.index(code)] if code in CUT else code
        extra = TRUNCATED * (code in CUT)
        made = {}
        for role in "sua":
            if role == own:
                cost, letter = KEEP + extra, "K"
            elif role != "s":
                cost, letter = REROLE + extra, "R"
            else:
                continue
            ways = [(b.value + INSERT * INSERTS[q, role], q) for q, b in best.items() if (q, role) in INSERTS]
            if not ways:
                continue
            least = min(ways)[0]
            audit = min(best[q].until(j - 1) + "I" * INSERTS[q, role] for v, q in ways if v == least)
            made[role] = least + cost - DELETE, audit + letter
        for role, (value, audit) in made.items():
            known = best.get(role)
            if known is None or value < known.value or value == known.value and audit < known.until(j):
                best[role] = _Best(value, audit, j)
    n = len(codes)
    return {q: (b.value + DELETE * n, b.until(n)) for q, b in best.items()}


@lru_cache(maxsize=65536)
def summary(codes: str) -> str:
    """before:after:cost:audit for each pair of states of a chunk. Short conversations have few codes, which a worker remembers."""
    return "|".join(f"{q}:{r}:{c}:{a}" for q in STATES for r, (c, a) in retained(codes, q).items())


def composed(chunks: Iterable[str]) -> tuple[int, str]:
    """Cost and audit of a conversation from the summaries of its chunks, in order."""
    now = {"": (0, "")}
    for ways in chunks:
        then: dict[str, tuple[int, str]] = {}
        for q, r, c, a in (way.split(":") for way in ways.split("|")):
            if q in now:
                found = now[q][0] + int(c), now[q][1] + a
                then[r] = min(then.get(r, found), found)
        now = then
    return min((c + INSERT * AT_END[q], a + "I" * AT_END[q]) for q, (c, a) in now.items())


def placed(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Rows of (_conv, _turn, _role, _text) with ``_place``, which orders each conversation: by turn (nulls first), role and text."""
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["_conv", "_turn", "_role"]
    dealt = turns.repartitionByRange(parts, *keys, F.substring("_text", 1, PREFIX)).sortWithinPartitions(*keys, "_text")
    return shared.table(spark, dealt.withColumn("_place", F.monotonically_increasing_id()), "turns-placed")


def _faults(rows: DataFrame) -> DataFrame:
    """(_conv, _turn, _place, _class, _fault): fault is blank, duplicate, truncated or null, the first that holds."""
    seen = rows.groupBy("_conv", "_role", F.sha2("_text", 256).alias("_digest")).agg(F.min("_place").alias("_first")).select("_first")
    shown = F.rtrim("_text", F.lit(" \t\n\x0b\f\r"))
    slim = rows.select("_conv", "_turn", "_place", F.substring("_role", 1, 1).alias("_initial"), (shown == "").alias("_blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("_open"))
    joined = slim.join(seen, F.col("_place") == F.col("_first"), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_open"), "truncated")
    known = F.when(F.col("_initial") == "s", 1).when(F.col("_initial") == "u", 2).when(F.col("_initial") == "a", 3).otherwise(4)
    return joined.select("_conv", "_turn", "_place", known.alias("_class"), fault.alias("_fault"))


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    shared.fresh(turns, conv, turn, role, text)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text"))


def _audits(rows: DataFrame) -> DataFrame:
    """Per conversation of placed rows: _conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    marked = _faults(rows)
    letters = F.when(F.col("_fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("_fault") == "truncated", F.lit(CUT)).otherwise(F.lit(PLAIN))
    code = F.substring(letters, F.col("_class"), F.lit(1))
    chunk = F.shiftright("_place", CHUNK_BITS).alias("_chunk")
    each = marked.groupBy("_conv", chunk).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", code.alias("code")))), lambda x: x["code"]), "").alias("_codes"),
        *(F.count_if(F.coalesce(F.col("_fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")),
    )

    @F.pandas_udf("string")
    def ways(parts: pd.Series) -> pd.Series:
        return parts.map(summary)

    @F.pandas_udf("struct<cost:long,audit:string>")
    def whole(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([composed(chunks) for chunks in parts], columns=["cost", "audit"])

    initials = F.translate("_codes", CUT + GONE, PLAIN + PLAIN)
    pairs = F.transform(F.sequence(F.lit(1), F.length(initials) - 1), lambda i: F.substring(initials, i, F.lit(2)))
    illegal = lambda xs: F.size(F.filter(xs, lambda p: ~p.isin(*LEGAL)))
    inside = F.when(F.length(initials) > 1, illegal(pairs)).otherwise(0)
    chunks = each.select("_conv", "_chunk", "blank", "duplicate", "truncated", inside.alias("_inside"), F.substring(initials, 1, 1).alias("_a"), F.substring(initials, -1, 1).alias("_z"), ways("_codes").alias("_ways"))
    sums = chunks.groupBy("_conv").agg(
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "_inside")), F.sort_array(F.collect_list(F.struct("_chunk", "_a", "_z", "_ways"))).alias("_c")
    )
    borders = F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c")), lambda x, y: F.concat(x["_z"], y["_a"]))
    done = sums.withColumn("_w", whole(F.transform("_c", lambda c: c["_ways"])))
    spans = marked.groupBy("_conv").agg(F.min("_turn").alias("_lo"), F.max("_turn").alias("_hi"), F.countDistinct("_turn").alias("_n"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.coalesce((wide("_hi") - wide("_lo") + 1 - wide("_n")).try_cast("long"), F.lit(0).cast("long"))
    spans = spans.select(F.col("_conv").alias("_same"), gaps.alias("gaps"))
    found = done.join(spans, F.col("_conv").eqNullSafe(F.col("_same")))
    return found.select("_conv", "gaps", "blank", "duplicate", "truncated", (F.col("_inside") + illegal(borders)).cast("long").alias("illegal"), "_w.cost", "_w.audit")


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Turns of each conversation in order, behind a row with its audit (place -1): what a task walks through without holding a conversation."""
    first = audits.select("_conv", F.lit(None).cast(dict(rows.dtypes)["_turn"]).alias("_turn"), F.lit("").alias("_role"), F.col("audit").alias("_text"), F.lit(-1).cast("long").alias("_place"))
    both = rows.select("_conv", "_turn", "_role", "_text", "_place").unionByName(first)
    # null ids are one conversation, and pandas must not see whether ids are numbers
    return both.withColumn("_turn", F.col("_turn").cast("string")).repartition("_conv").sortWithinPartitions("_conv", "_place").withColumn("_conv", F.col("_conv").cast("string"))


class _Walk:
    """Edits of one conversation, turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        stay = len(audit) - audit.count("D")
        self.system = stay % 2  # an odd number of turns begins with the system's

    def role(self) -> str:
        self.out += 1
        return "" if self.system and self.out == 1 else ROLES["ua"[(self.out - 1 - self.system) % 2]]

    def inserts(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.role()

    def turn(self, role: str) -> tuple[str, str | None]:
        """The edit of the next turn and its role then, None if it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return edit, None
        new = self.role()
        return edit, role if edit == "K" else new


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(begins, conv, turn, role, text, edit) of each turn that a whole conversation has; ``begins`` marks a row without a turn that opens one."""
    walk, conv = None, None

    def tail() -> Iterator[tuple]:
        for made in walk.inserts() if walk else ():
            yield False, conv, None, made, "", "I"

    for batch in batches:
        for new, turn, role, text, place in batch[["_conv", "_turn", "_role", "_text", "_place"]].itertuples(index=False, name=None):
            if place == -1:
                yield from tail()
                walk, conv = _Walk(text), new
                yield True, conv, None, None, None, None
                continue
            for made in walk.inserts():
                yield False, conv, None, made, "", "I"
            edit, kept = walk.turn(role)
            if kept is not None:
                yield False, conv, turn, kept, text, edit
    yield from tail()


def audited(spark: SparkSession, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv, its faults (gaps, blank, duplicate, truncated, illegal), cost and audit of the cheapest repair.

    Turns are taken by number (nulls first), then role, then text; rows that repeat a turn are duplicates of the first. Null role and text
    count as one space, so such a text is blank and such a role must change. Null conversation ids form one conversation. ``gaps`` are numbers
    missing between the least and the greatest, nulls left aside. Roles are told by their first letter as written.
    Texts of any length are judged whole. An empty table gives an empty result; further columns are not looked at. A conversation's audit
    is one string, a letter a turn.
    """
    rows = placed(spark, _prepared(turns, conv, turn, role, text))
    found = _audits(rows)
    return found.select(F.col("_conv").alias(conv), *(c for c in found.columns if c != "_conv"))


def repaired(spark: SparkSession, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of whole conversations: conv, position (from 0), turn (null where inserted), role, text, edit (K, R or I). Cases as for ``audited``."""
    rows = placed(spark, _prepared(turns, conv, turn, role, text))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, position = [], 0
        names = ["_conv", "position", "_turn", "_role", "_text", "edit"]
        for begins, c, t, r, x, e in _walked(batches):
            position = 0 if begins else position
            if not begins:
                held.append((c, position, t, r, x, e))
                position += 1
            if len(held) >= shared.BATCH_ROWS:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    done = _stream(rows, _audits(rows)).mapInPandas(run, "_conv string, position long, _turn string, _role string, _text string, edit string")
    return done.select(F.col("_conv").cast(kinds["_conv"]).alias(conv), "position", F.col("_turn").cast(kinds["_turn"]).alias(turn), F.col("_role").alias(role), F.col("_text").alias(text), "edit")


def digested(spark: SparkSession, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """As ``audited``, with ``repaired_sha256`` of the whole conversation's ``role:text`` lines.

    A digest runs over its lines one after the other, so one task walks through a conversation's turns; it holds none of them.
    """
    rows = placed(spark, _prepared(turns, conv, turn, role, text))
    kind = dict(rows.dtypes)["_conv"]
    audits = shared.table(spark, _audits(rows), "turn-audits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, conv_id, lines, done = None, None, 0, []
        for begins, c, _, r, x, _ in _walked(batches):
            if begins:
                if state:
                    done.append((conv_id, state.hexdigest()))
                state, conv_id, lines = hashlib.sha256(), c, 0
            else:
                state.update(f"{chr(10) if lines else ''}{r}:{x}".encode())
                lines += 1
            if len(done) >= shared.BATCH_ROWS:
                yield pd.DataFrame(done, columns=["_conv", "_sha"])
                done = []
        if state:
            done.append((conv_id, state.hexdigest()))
        yield pd.DataFrame(done, columns=["_conv", "_sha"])

    shas = _stream(rows, audits).mapInPandas(run, "_conv string, _sha string").select(F.col("_conv").cast(kind).alias("_same"), "_sha")
    found = audits.join(shas, F.col("_conv").eqNullSafe(F.col("_same")))
    return found.select(F.col("_conv").alias(conv), *(c for c in audits.columns if c != "_conv"), F.col("_sha").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn``; nulls count as one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(own("text"), "[.!?]", "")).otherwise(own("text"))
    role = F.when(kind == 4, "user").otherwise(own("role"))
    times: Column = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = digested(spark, damaged(turns)).withColumnRenamed("conv_id", "_own")
    every = turns.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_own")), "left")
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a plain forward recursion over turns and four states, each a string of nine digits of cost and the audit."""
    add = lambda s, c, letters: f"CASE WHEN {s} IS NOT NULL THEN printf('%09d', CAST(left({s}, 9) AS INT) + {c}) || substr({s}, 10) || '{letters}' END"
    ways = lambda cost, letter, free, dear: "least(" + ", ".join([*(add(q, f"{cost} + t", letter) for q in free), *(add(q, f"{cost} + 2 + t", f"I{letter}") for q in dear)]) + ")"

    def state(own: str, initial: str, free: tuple, dear: tuple) -> str:
        return f"least({add(own, 3, 'D')}, CASE WHEN g THEN NULL WHEN i = '{initial}' THEN {ways(0, 'K', free, dear)} ELSE {ways(2, 'R', free, dear)} END)"

    crc = "list_reduce(flatten(list_transform(string_split(s, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
d AS (SELECT *, xor({crc}, 4294967295) % 20 AS k FROM k),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER w AS n, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, {white}) AS shown
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, shown = '' OR again AS g, CASE WHEN right(shown, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS t FROM o),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000' AS s0, NULL::VARCHAR AS ss, NULL::VARCHAR AS su, NULL::VARCHAR AS sa FROM f
  UNION ALL SELECT r.conv_id, f.n, {add("s0", 3, "D")}, least({add("ss", 3, "D")}, CASE WHEN NOT g AND i = 's' THEN {add("s0", "t", "K")} END), {state("su", "u", ("s0", "ss", "sa"), ("su",))}, {state("sa", "a", ("su",), ("s0", "ss", "sa"))}
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1),
e AS (SELECT conv_id, arg_max(least(s0, {add("ss", 4, "II")}, {add("su", 2, "I")}, sa), n) AS best FROM r GROUP BY conv_id),
b AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM e),
l AS (SELECT conv_id, audit, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS n, length(replace(left(audit, p), 'D', '')) AS j, length(replace(audit, 'D', '')) % 2 AS odd FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM b)),
z AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p)) AS sha
  FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = greatest(l.n, 1) WHERE edit <> 'D' GROUP BY l.conv_id),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE shown = '') AS blank, count(*) FILTER (WHERE shown <> '' AND again) AS duplicate, count(*) FILTER (WHERE NOT g AND t = 1) AS truncated,
  count(*) FILTER (WHERE n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


SQL = _sql()
