"""Repair of conversations, shards, and ids that pandas would round."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silvergrain.llm import bpe_codec, language_id, near_dedup, packing, sharding, shared, token_counts, toxicity, turn_repair

BIG = 2**53 + 1


def test_ids_beside_a_null_stay_exact(spark):
    shared.ship(spark)
    ids = [BIG, 2**53, None, 2**63 - 1, -(2**53) - 1]
    docs = spark.createDataFrame([(i, f"the words of text {k}.", "en", "s", 0) for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    model = toxicity.fit(spark, docs, spark.createDataFrame([(BIG, 1, 0)], "doc_id long, quality int, toxic int"))
    langs, p = language_id.fit(spark, docs, F.lit(True))
    codes = bpe_codec.encode(docs)
    made = {
        "language": language_id.predict(spark, docs, langs, p, carry=(F.col("doc_id").alias("again"),)), "toxicity": toxicity.score(spark, docs, model), "codes": codes, "decoded": bpe_codec.decode(codes),
        "digests": bpe_codec.digests(docs), "counts": token_counts.token_counts(docs), "prefixes": token_counts.prefix_counts(docs), "packed": packing.pack(spark, docs), "stage": corpus_pipeline.packed(spark, docs, ""),
    }
    for name, df in made.items():
        found = df.collect()
        assert {r["doc_id"] for r in found} == set(ids), name
        if name == "language":
            assert all(r["again"] == r["doc_id"] for r in found)


# --- repair of conversations


def brute(turns, most):
    """The cheapest whole sequence over all edits, with up to ``most`` insertions in a gap: (cost, audit, lines). turns: role, text, must go, truncated."""
    gaps = [g for n in range(most + 1) for g in itertools.product("ua", repeat=n)]
    names, best = {"u": "user", "a": "assistant"}, None
    choices = [["D"] if gone else ["K", "D", "Ru", "Ra"] for _, _, gone, _ in turns]
    for edits in itertools.product(*choices):
        base = sum({"K": 0, "D": 3}.get(e, 2) + (e != "D" and t[3]) for e, t in zip(edits, turns))
        if best and base > best[0]:
            continue
        for filled in itertools.product(gaps, repeat=len(turns) + 1):
            cost = base + 2 * sum(map(len, filled))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for i in range(len(turns) + 1):
                audit += "I" * len(filled[i])
                lines += [(names[r], "") for r in filled[i]]
                if i < len(turns):
                    audit += edits[i][0]
                    if edits[i] != "D":
                        lines.append((turns[i][0] if edits[i] == "K" else names[edits[i][1]], turns[i][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def code(role, gone, cut):
    i = "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3
    return (turn_repair.GONE if gone else turn_repair.CUT if cut else turn_repair.PLAIN)[i]


@pytest.mark.parametrize("seed", range(6))
def test_programme_equals_all_edits(seed):
    rnd = random.Random(seed)
    for n, most in [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1)]:
        for _ in range(6 if n > 2 else 12):
            turns = [(rnd.choice(["user", "assistant", "system", "tool", "user", "assistant"]), str(i), rnd.random() < 0.2, rnd.random() < 0.2) for i in range(n)]
            codes = "".join(code(r, g, c) for r, _, g, c in turns)
            cost, audit, lines = brute(turns, most)
            for cut in range(n + 1):  # wherever chunks are cut
                assert turn_repair.composed([turn_repair.summary(codes[:cut]), turn_repair.summary(codes[cut:])]) == (cost, audit), (turns, audit)
            walk, out = turn_repair._Walk(audit), []
            for r, x, _, _ in turns:
                out += [(m, "") for m in walk.inserts()]
                _, kept = walk.turn(r)
                out += [(kept, x)] if kept is not None else []
            assert out + [(m, "") for m in walk.inserts()] == lines


def odd_turns():
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "", "User"]), rnd.choice(["Yes.", "no", " \t", None, "", "what?!  \n", "Yes."])) for c in [1, 2, None] for t in [0, 1, 1, 3, None, 7, 7, 9]]
    rows += [(5, 2**62, "user", "a."), (5, -(2**62), "assistant", "b."), (6, None, "user", "x" * 200_000), (6, None, "user", "x" * 200_000 + ".")]
    rows += [(8, i, "user" if i % 2 else "assistant", f"t{i}" + "." * (i % 3)) for i in range(6000)]  # over several chunks
    rows += [(9, 4, "user", "again.")] * 300
    return rows


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == c])
        seen, faults, codes = set(), [], ""
        for _, _, role, text in own:
            shown = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            codes += code(role, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = turn_repair.composed([turn_repair.summary(codes)])
        walk, lines = turn_repair._Walk(audit), []
        for _, _, role, text in own:
            lines += [f"{m}:" for m in walk.inserts()]
            _, kept = walk.turn(role)
            lines += [f"{kept}:{text}"] if kept is not None else []
        lines += [f"{m}:" for m in walk.inserts()]
        turns = {r[1] for r in rows if r[0] == c} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps if gaps < 2**63 else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def test_repair_of_odd_turns(spark):
    shared.ship(spark)
    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("_conv", "_place", "_role", "cost", "audit", "_turn", "place")})
    want = expected(rows)
    found = {r["conv_id"]: r for r in turn_repair.digested(spark, df).collect()}
    assert set(found) == set(want)
    for c, r in found.items():
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == want[c][:-1], c
    lines = {}
    for r in turn_repair.repaired(spark, df).orderBy("conv_id", "position").collect():
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: lines.get(c, []) for c in want} == {c: w[-1] for c, w in want.items()}
    assert turn_repair.digested(spark, df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Is it? Yes.") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    out = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        own = [" " if x is None else x for x in (c, t, role, text)]
        k = zlib.crc32(f"{own[0]}:{own[1]}".encode()) % 20
        want += [(c, t, "user" if k == 4 else own[2], "" if k == 1 else re.sub("[.!?]", "", own[3]) if k == 2 else own[3])] * {0: 0, 3: 2}.get(k, 1)
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_repair_query_keeps_conversations_without_turns(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x."), (gone + 1, 0, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert len(found) == 2 and tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- shards


def sized_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("_group", "_salt", "_size", "_range", "size", "slot")})


def check_shards(rows, found, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards_against_a_sorted_list(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcdé日 ") for _ in range(rnd.randint(0, 400)))) for i in range(3000)]
    rows += [(10_000 + i, "the same text " * 9) for i in range(1500)] + [(20_000 + i, f"pair {i // 2}") for i in range(200)] + [(None, None), (None, ""), (7, None), (7, "x"), (7, "x")]
    df = sized_docs(spark, rows)
    found = sharding.shards_of(spark, df, 8).collect()
    sizes = check_shards(rows, found, 8)
    total = sum(sizes.values())
    keys = {(r["doc_id"], r["text"]): (r["_group"], r["_salt"]) for r in sharding.keyed(df.drop("_group", "_salt", "_size"), "doc_id", "text").collect()}
    ordered = sorted(((keys[i, t], i, t) for i, t in rows), key=lambda x: x[0])
    groups, want, begin = {}, {}, 0
    for (g, _), _, t in ordered:
        groups[g] = groups.get(g, 0) + len((t or "").encode()) + 1
    first = {}
    ranges = max(sharding.LEAST, sharding.EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    for (g, _), i, t in ordered:
        n = len((t or "").encode()) + 1
        first.setdefault(g, begin)
        together = groups[g] * max(sharding.TOGETHER * 8, 4 * ranges) <= total
        b, s = (first[g], groups[g]) if together else (begin, n)
        want.setdefault((i, zlib.crc32((t or "").encode())), set()).add(min(7, (2 * b + s) * 8 // (2 * total)))
        begin += n
    assert all(r["shard"] in want[r["doc_id"], r["text_crc32"]] for r in found)
    assert max(abs(v - total / 8) for v in sizes.values()) <= 1300
    place = {}
    for r in found:
        place.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert len(place[zlib.crc32(b"the same text " * 9), 127]) > 1  # a third of all rows: cut
    assert all(len(place[zlib.crc32(f"pair {i}".encode()), len(f"pair {i}") + 1]) == 1 for i in range(100))


def test_shards_of_odd_tables(spark):
    for rows in ([], [(1, "x" * 300_000)], [(1, "x" * 300_000), (2, None), (3, ""), (None, "z")], [(5, "same")] * 50):
        sizes = check_shards(rows, sharding.shards_of(spark, sized_docs(spark, rows), 8).collect(), 8)
        assert sum(sizes.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)


def test_an_overfull_range_is_divided(spark, monkeypatch):
    # a sample that saw nothing gives one range; division must find the rest
    drawn, calls = sharding._drawn, []
    monkeypatch.setattr(sharding, "_drawn", lambda rows, rate, seed: (calls.append(seed), drawn(rows, rate, seed).where("false") if seed == 0 else drawn(rows, rate, seed))[1])
    rows = sharding.keyed(spark.createDataFrame([(i, "same" if i % 3 else f"text {i}" * 5) for i in range(20_000)], "doc_id long, text string"), "doc_id", "text").cache()
    _, sizes, ranges = sharding.splitters(spark, rows)
    assert calls[:2] == [0, 1] and len(sizes) > 100
    assert sizes["bytes"].max() <= sharding.OVERFULL * sizes["bytes"].sum() / ranges


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, f"text {i % 700} " * (i % 50)) for i in range(2000)] + [(None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_group", F.lit(1))
    sharding.write_shards(spark, df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(repr, rows))
    found = sharding.shards_of(spark, df, 4).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    wrote = back.groupBy("shard").agg(F.sum(sharding.text_size(F.col("text"))).alias("n")).collect()
    assert {r["shard"]: r["n"] for r in found} == {r["shard"]: r["n"] for r in wrote}


# --- near copies


def test_rows_that_repeat_an_id_are_its_smallest_text(spark):
    shared.ship(spark)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "z " + long), (2, long + " a"), (2, long + " a"), (3, "something else altogether, of other words"), (3, "z " + long), (4, long), (None, long)]
    for order in (rows, rows[::-1]):
        found = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"], r["kept"]) for r in near_dedup.classes(spark, spark.createDataFrame(order, "doc_id long, text string")).collect())
        assert found == [(0, 0, 1, True), (1, 1, 3, True), *[(2, 1, 3, False)] * 3, *[(3, 3, 1, True)] * 2, (4, 1, 3, False)]


def test_classes_of_weights_part_no_pair_that_may_link(spark):
    """Pairs by prefix equal those of all pairs that share a counted shingle and are close enough in weight."""
    import random as R

    rnd, n = R.Random(3), 60
    rows, weight = [], {}
    for i in range(n):
        own = own[rnd.randint(0, 1) :] if i % 3 else rnd.sample(range(40), rnd.randint(3, 30))  # near copies of the one before
        rows += [(i, s, 1.0, 2 + s) for s in own]
        weight[i] = float(len(own))
    counted = spark.createDataFrame(rows, "n long, s long, x double, place long")
    known = spark.createDataFrame([(i, w, w, None, 0.0, i) for i, w in weight.items()], "n long, w double, v double, p long, s_ double, c long")
    other = [F.col("w").alias("pw"), F.col("v").alias("pv")]
    most = F.least("v", "pv")
    got = {tuple(sorted((r["a"], r["b"]))) for r in near_dedup.prefix_pairs(counted, known, most >= near_dedup.SIMILAR * (F.col("w") + F.col("pw") - most) - near_dedup.EPS, other).collect()}
    sets = {i: {s for j, s, *_ in rows if j == i} for i in range(n)}
    linked = {(a, b) for a in range(n) for b in range(a + 1, n) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(linked) > 20 and linked <= got and all(min(weight[a], weight[b]) >= 0.79 * max(weight[a], weight[b]) for a, b in got)
