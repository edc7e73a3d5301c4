"""The operators of the training-data pipeline against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from silvergrain.llm import bpe_codec, chat_format, exact_dedup, fingerprints, language_id, near_dedup, packing, registry, suffix_dedup, token_counts, toxicity

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    """Documents with a null language, and columns whose names the operators use inside."""
    rows = [(i + start, t, None, "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, TEXT).withColumn("_id", F.lit("x")).withColumn("_text", F.lit("y")).withColumn("_hash", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("h", F.lit(2))


def odd_texts(n=150, seed=3):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(" \n\t'abcdelrstv.!1é日<|>ΣİA") for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return [None, "", " ", "  a", "it's they're I'll 'S", "<|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "日本語 です。", "c\x1cd \x85 e", "²½Ⅷ 123", "A" * 3000, "=" * 500 + " " * 400, "🙂👍🏽", " a", "a" * 50 + " " + "b" * 50, *made]


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library_and_round_trips(spark, tiktoken_codec):
    texts = [*odd_texts(), "a lot of words " * 10_000, "q" * 2000]
    texts += texts[-3:]
    ids = bpe_codec.encode(docs(spark, texts)).cache()
    found = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe_codec.decode(ids).collect()}
    for i, t in enumerate(texts):
        assert found[i] == tiktoken_codec.encode_ordinary(t or "")
        assert back[i] == (t or "").encode()
    digest = {r["doc_id"]: r for r in bpe_codec.digests(docs(spark, texts)).collect()}
    assert all(digest[i]["ids_sha256"] == hashlib.sha256(np.asarray(found[i], "<u4").tobytes()).hexdigest() for i in found)
    assert all((digest[i]["n_tokens"], digest[i]["decoded_sha256"]) == (len(found[i]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts))
    assert bpe_codec.encode(docs(spark, ["x"]).limit(0)).count() == 0


def test_counts_at_every_prefix():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    own = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    rnd = random.Random(9)
    blanks = ["".join(rnd.choice(["a", "we're", "'ll", " ", "  ", "\n", "\n\n ", "<|endoftext|>", "x.", "\x85", "\x1c"]) for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    for t in [*(t for t in odd_texts(60, 5) if t and len(t) < 100), *blanks]:
        stored = own.prefixes(t)
        want = [count(t[:n]) for n in range(len(t) + 1)]
        assert [own.count_at(t, n, stored) for n in range(len(t) + 1)] == want
        for budget in (0, 2, 5):
            longest = max(n for n, c in enumerate(want) if c <= budget)
            assert own.longest_within(t, budget, stored) == longest
            assert [x.tolist() for x in own.answers([t, "", "a b", t], budget)] == [[want[-1], 0, 2, want[-1]], [longest, 0, 3 if budget > 1 else 0, longest]]


def test_prefix_questions_encode_nothing(monkeypatch):
    """Once the counts are stored, a question neither splits nor encodes."""
    own = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    text = "Some words, and <|endoftext|> more  of them.\n" * 50
    stored = own.prefixes(text)
    for name in ("parts", "byte_counts", "of", "_plain"):
        monkeypatch.setattr(token_counts.PrefixCounter, name, lambda *a: pytest.fail("encoded"))
    assert own.count_at(text, len(text), stored) == stored[-1]
    assert 0 < own.longest_within(text, 100, stored) < len(text)


def test_kept_is_bounded_and_keeps_what_is_asked_for():
    from silvergrain.llm import shared

    made = []
    kept = shared.Kept(lambda k: made.append(k) or len(k), 10)
    for i in range(100):
        assert kept["often"] == 5 and kept[f"k{i}"] == len(f"k{i}") and kept["x" * 100] == 100
    assert made.count("often") == 1 and made.count("x" * 100) == 100 and len(kept) + len(kept.older) <= 20


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*odd_texts(), "word and " * 20_000, "z" * 20_000]
    texts += texts[-3:]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in token_counts.token_counts(docs(spark, texts), 20).collect():
        text = texts[r["doc_id"]] or ""
        n = count(text)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 20, len(text.encode()))
        assert r["limit_chars"] == (len(text) if n <= 20 else max(k for k in range(min(len(text), 600)) if count(text[:k]) <= 20))
    assert len(token_counts.prefix_counts(docs(spark, ["ab c"])).first()["counts"]) == 4
    assert token_counts.token_counts(docs(spark, ["x"]).limit(0)).count() == 0


def test_every_token_is_what_its_characters_merge_to():
    """What lets the packing encoder go through a model of the vocabulary."""
    own = packing.encoder(P.path("word_bpe_49k.json"))
    n = own.model.get_piece_size() - 1
    pieces = [own.model.id_to_piece(i) for i in range(n)]
    assert own.model.encode(pieces) == [[i] for i in range(n)]


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*odd_texts(), "a lot of words, " * 3000, "q" * 2000]
    own = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pieces(spark, docs(spark, texts), 128).collect()
    seen, filled = {i: [] for i in own}, {}
    for r in rows:
        piece = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(piece, "<u4").tobytes()) and r["doc_tokens"] == len(own[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == len(own[i])
    for k, parts in filled.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) == 128 or k == max(filled)
    whole = {r["doc_id"]: list(r["ids"]) for r in packing.pack(spark, docs(spark, ["a b"])).collect()}
    assert whole == {0: [*library.encode("a b", add_special_tokens=False).ids, 2]}
    twice = docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"])).unionByName(docs(spark, ["d"]))
    assert sorted(r["doc_tokens"] for r in packing.pieces(spark, twice).collect()) == [2, 4, 4]
    assert packing.pieces(spark, docs(spark, ["x"]).limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<a>"), (1, 2, "assistant", "\\b\\l</turn>"), (1, 3, "user", None), (2, 0, "system", ""), (2, 300, "assistant", "late"), (2, 300, "assistant", "late"), (2, None, None, "first"), (None, 0, "assistant", "x</role><assistant>")]
    marks = ["us>er", "<a", "</turn>", "\\", "</role>", "\\g\\l", "><", "assistant"]
    rows += [(3, i, r, r + "\n") for i, r in enumerate(marks)] + [(4, 0, "assistant", "y" * 300_000), (4, 1, "user", ">" * 300_000), (4, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = chat_format.format_chats(turns)
    found = {r["conv_id"]: r for r in done.select("conv_id", chat_format.parsed(F.col("formatted")).alias("t"), chat_format.under_mask(F.col("formatted"), F.col("mask")).alias("loss"), "formatted", F.size("mask").alias("n")).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["t"]] == [("user", "hi"), ("assistant", "<a>"), ("assistant", "\\b\\l</turn>"), ("user", "")]
    assert found[1]["loss"] == "<a>\\b\\l</turn>" and found[1]["n"] == 2
    assert [(t["role"], t["text"]) for t in found[3]["t"]] == [(r, r + "\n") for r in marks] and found[3]["loss"] == "assistant\n"
    assert found[4]["loss"] == "y" * 300_000 + "z" and found[4]["t"][1]["text"] == ">" * 300_000
    assert [(t["role"], t["text"]) for t in found[2]["t"]] == [("", "first"), ("system", ""), ("assistant", "late"), ("assistant", "late")]
    assert found[2]["formatted"].count("<assistant>") == 1
    assert found[None]["loss"] == "x</role><assistant>"
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_chat_chunks_join(spark):
    """A conversation over several chunks: runs of one role that cross a border are one block."""
    turns = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") < 600, "assistant").otherwise("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat_format.format_chats(turns).select("formatted", "mask", chat_format.under_mask(F.col("formatted"), F.col("mask")).alias("loss"), F.size("mask").alias("n")).first()
    assert row["formatted"].count("</role>") == 2 and row["n"] == 600
    assert [row["formatted"][m["start"] - 1 :][: m["length"]] for m in row["mask"]] == list(map(str, range(600)))
    assert row["loss"] == "".join(map(str, range(600)))


@pytest.mark.parametrize("sent", [1 << 18, 0], ids=["sent", "joined"])
@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.length(c).cast("long")], ids=["hash", "collisions"])
def test_exact_dedup(spark, monkeypatch, hash_of, sent):
    monkeypatch.setattr(exact_dedup, "SENT", sent)
    texts = [None, "", " ", "a b", "a \t\n b", "a  b", "b a", " a b", "x" * 100_000, "x" * 100_000, "a b"]
    norm = lambda t: regex.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    found = {r["doc_id"]: r for r in exact_dedup.classes(spark, docs(spark, texts, 5), hash_of=hash_of).collect()}
    for i, t in enumerate(texts):
        same = [j + 5 for j, u in enumerate(texts) if norm(u) == norm(t)]
        r = found[i + 5]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(same), len(same), i + 5 == min(same), hashlib.sha256(norm(t).encode()).hexdigest())
    assert exact_dedup.classes(spark, docs(spark, ["x"]).limit(0)).count() == 0
    rows = exact_dedup.kept_rows(spark, docs(spark, ["a", "a", "b"]).unionByName(docs(spark, ["a"])))
    assert sorted((r["doc_id"], r["text"]) for r in rows.collect()) == [(0, "a"), (2, "b")]


def test_hot_groups_are_combined_before_they_reach_their_owner(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 5)
    for hash_of in (F.xxhash64, lambda c: F.length(c).cast("long")):
        texts = ["again and"] * 40 + ["\tagain  and"] * 20 + ["other and"] * 30 + [f"text {i}" for i in range(30)]
        found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.classes(spark, docs(spark, texts), hash_of=hash_of).collect()}
        assert len(found) == 120 and found[5] == (0, 40) and found[41] == (40, 20) and found[70] == (60, 30) and found[119] == (119, 1)


def test_directory_doubles(spark):
    index = spark.range(5000).select(F.xxhash64("id").alias("_hash"))
    rows = exact_dedup.directory(index, capacity=300, max_depth=8).collect()
    buckets = {(r["start"], r["depth"]): r["n_entries"] for r in rows}
    assert sum(buckets.values()) == 5000 and max(buckets.values()) <= 300
    assert sum(2.0**-d for _, d in buckets) == 1
    crowded = spark.range(100).select(F.lit(7).cast("long").alias("_hash"))
    assert [(r["depth"], r["n_entries"]) for r in exact_dedup.directory(crowded, 10, 4).collect()] == [(4, 100)]


def test_index_keeps_buckets_whole(spark):
    own = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    index, placed = exact_dedup.build_index(spark, own, exact_dedup.keys(spark, own), capacity=100)
    files = index.select("start", F.input_file_name().alias("f")).distinct().groupBy("start").count()
    assert index.count() == 3000 and files.count() > 16 and files.where("count > 1").isEmpty()
    assert index.groupBy("start").count().agg(F.max("count")).first()[0] <= 100
    probes = placed(own.select("doc_id", F.xxhash64("text").alias("_hash")))
    assert probes.join(index, ["start", "_hash"]).where("doc_id = keep_id").count() == 3000  # the directory leads each row to its entry


def test_fingerprints(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(3000))
    texts = [None, "", "a", "\x00", "\x00" * 11, "é" * 6, "\x00ÿ\x7f\x80" * 30, "x" * 200, base, base, base[:1500] + "ZZ" + base[1500:], "short text here"]
    found = {r["doc_id"]: [(p["hash"], p["place"]) for p in r["prints"]] for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    pieces = sorted({t.encode()[i : i + 6] for t in texts if t for i in range(max(7, len(t.encode())))})
    piece = {bytes(r["g"]): r["h"] for r in spark.createDataFrame([(bytearray(g),) for g in pieces], "g binary").select("g", F.hash("g").alias("h")).collect()}
    value = lambda g: (piece[g[:6]] * 48271 + piece[g[6:12]]) & (2**31 - 1)
    for i, t in enumerate(texts):
        data, want = (t or "").encode(), []
        hs = [value(data[j : j + 12]) for j in range(max(1, len(data) - 11))] if data else []
        for s in range(max(1, len(hs) - 23)) if hs else []:
            window = hs[s : s + 24]
            at = max(j for j, v in enumerate(window) if v == min(window)) + s
            if not want or want[-1] != (hs[at], at + 1):
                want.append((hs[at], at + 1))
        assert found[i] == want
    same = texts.index(base)
    assert found[same] == found[same + 1] and len({h for h, _ in found[same]} & {h for h, _ in found[same + 2]}) > 200


def test_successors(spark, tmp_path, monkeypatch):
    """Null and repeated ids, empty texts, ids far apart, ranges of a few rows, one row, no rows: each row's successor by descending id."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 40)
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["", "x" * (i % 90), "word " * (i % 7)])) for i in [*range(50), 10**9, -(10**9), 10**15]] + [(7, "again"), (7, "again"), (9, None), (None, "lost")]
    for given in (rows, rows[:1], rows[:2], []):
        own = spark.createDataFrame(given, "_id long, _text string").select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
        found = fingerprints.successors(spark, own).collect()
        assert len(found) == len(given)
        after = {}
        for r in found:
            after.setdefault(r["_id"], []).append(r["_next_text"])
        order = sorted((i for i, _ in given if i is not None), reverse=True) + [i for i, _ in given if i is None]
        texts = {i: sorted(t or "" for j, t in given if j == i) for i, _ in given}
        for i in set(order):
            last = max(k for k, j in enumerate(order) if j == i)
            follows = order[(last + 1) % len(order)]
            # one of the rows of an id is followed by the next id's first, the others by rows of their own id
            left = sorted(after[i])
            assert len(left) == order.count(i) and any(t in texts[follows] for t in left)
            assert sum(t in texts[i] for t in left) >= order.count(i) - 1
    long = spark.createDataFrame([(1, "y" * 300_000), (2, "y" * 300_000)], "_id long, _text string")
    done = fingerprints.successors(spark, long).select("_id", F.size("_prints").alias("n"), (F.col("_prints") == F.col("_next_prints")).alias("same")).collect()
    assert [r["same"] for r in done] == [True, True]


def test_ranges_hold_equal_counts(spark, monkeypatch):
    """However far apart ids lie, and for rows without an id too."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)
    rows = [(i, f"text {i} " * 4) for i in [*range(19_999), 10**12]] + [(None, f"lost {i} " * 4) for i in range(10_000)]
    own = spark.createDataFrame(rows, "_id long, _text string")
    found = fingerprints.ranges(own)(own)
    for known in ("_id IS NOT NULL", "_id IS NULL"):
        sizes = [r["count"] for r in found.where(known).groupBy("_range").count().collect()]
        assert len(sizes) > 60 and max(sizes) <= 2 * sum(sizes) / len(sizes) + 2
    order = [r["_range"] for r in found.where("_id IS NOT NULL").orderBy("_id").collect()]
    assert order == sorted(order)


def test_edited_fingerprints_equal_those_of_the_edited_text(spark, sf_dir):
    rows = registry.queries()["op6_fingerprints"](spark, sf_dir).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    made = {}
    for k, (i, t) in enumerate(texts):
        m, after = len(t) // 3, texts[(k + 1) % len(texts)][1]
        made[i] = t[: len(t) - m] + after[:m]
    direct = fingerprints.fingerprints(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    want = {r["doc_id"]: r["f"] for r in direct.select("doc_id", fingerprints.written(F.array_distinct(F.transform("prints", lambda p: p["hash"].cast("long")))).alias("f")).collect()}
    for r in rows:
        assert r["edited_sha256"] == hashlib.sha256(made[r["doc_id"]].encode()).hexdigest()
        assert r["edited_fingerprint"] == want[r["doc_id"]]
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in rows])


def repeats(texts):
    """Brute force: removed bytes, runs and what is left."""
    times = {}
    for t in texts:
        for i in range(len(t) - 199):
            times[t[i : i + 200]] = times.get(t[i : i + 200], 0) + 1
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if times[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\x01" * 200
        out.append((len(t), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), hashlib.sha256(bytes(c for c, h in zip(t, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8192, 1, 3], ids=["whole", "halved to the end", "halved"])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passage = word(400)
    texts = [None, "", "x", passage, word(50) + passage + word(30), word(300), word(10) + passage[:250] + word(100) + passage[100:], "For " * 200, "a" * 199, "a" * 200, "b" * 201, "日本" * 90 + passage[:190]]
    texts += [word(60) + passage + word(rnd.randint(1, 300)) for _ in range(10)]
    found = {r["doc_id"]: r for r in suffix_dedup.report(spark, docs(spark, texts)).collect()}
    for i, want in enumerate(repeats([(t or "").encode() for t in texts])):
        assert tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    twice = docs(spark, [word(300)])
    assert [r["n_removed"] == r["n_bytes"] for r in suffix_dedup.report(spark, twice.unionByName(twice)).collect()] == [True, True]
    assert suffix_dedup.report(spark, docs(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("r", [0, 1, 2])
def test_difference_cover(r):
    v, members = suffix_dedup.difference_cover(r)
    assert len(members) == 6 * r + 4
    assert {(a - b) % v for a in members for b in members} == set(range(v))


def test_maximal_segments():
    rnd = random.Random(4)

    def brute(s):
        """All maximal scoring segments by their definition: take the best one, then go on left and right of it."""
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]

    for _ in range(200):
        s = [rnd.choice([-3.5, -2.25, -1.125, 1.03125, 2.0625, 4.25]) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute(s)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.queries()["op2_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in rows.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / n[0, 0] < 0.01


def test_toxicity_edges(spark):
    texts = [None, "", "fine words here"] * 100 + ["you idiot moron scum", "what a moron idiot"] * 20
    own = docs(spark, texts)
    labels = own.select("doc_id", F.when(F.col("text").contains("moron"), 1).otherwise(0).alias("toxic"))
    model = toxicity.fit(spark, own, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark, own, model).collect()}
    assert len(found) == len(texts) and found[300] > found[2] and found[0] == found[1]
    assert toxicity.passages(spark, own.where("doc_id >= 300"), model).count() >= 0
    blank = toxicity.fit(spark, own, labels.where("toxic = 0"))
    assert {r["score"] < 0.1 for r in toxicity.score(spark, own, blank).collect()} == {True}
    assert toxicity.score(spark, own.limit(0), model).count() == 0


def test_tokens_of_toxic_texts_alone_score_high():
    """A token's bound stays finite where it has no clean occurrence, and more occurrences move it up."""
    import pandas as pd

    rows = [(0, "zappier", 90, 0), (0, "zapping", 4, 0), (0, "plain", 90, 900), (0, "clean", 0, 900), (3, "zap", 94, 0), (4, "zapp", 94, 0), (5, "zappi", 94, 0), (3, "pla", 90, 900), (3, "cle", 0, 900), (3, "oth", 10, 3000)]
    model = toxicity.token_scores(pd.DataFrame(rows, columns=["level", "token", "toxic", "clean"]))
    assert model.tokens["zappier"] > 2 and model.tokens["zappish"] > 2 and model.tokens["zapping"] > 2
    assert -toxicity.DRIFT <= model.tokens["plain"] < 1 and model.tokens["clean"] < -2 and model.tokens["unseen"] == -toxicity.DRIFT
    z = toxicity.CAUTION
    for t, c in ((5.0, 0.01), (90.0, 3.0), (0.5, 40.0)):  # Wilson's bounds solve (p - t / n)**2 = z**2 p (1 - p) / n
        for p in toxicity.wilson(t, c):
            assert (p - t / (t + c)) ** 2 == pytest.approx(z * z * p * (1 - p) / (t + c))


def test_scores_equal_a_row_by_row_version(spark):
    """Scores of a whole table against segments by definition, the law and the calibration, text by text; ties, repeats, null and long texts."""
    texts = [None, "", "fine words here", "you idiot moron scum", "you idiot moron scum", "plain " * 30_000, ("plain " * 300 + "idiot moron ") * 20, "moron", "ab " * 500 + "idiot"]
    train = docs(spark, ["fine words here", "plain ab here", "you moron here", "idiot moron scum"] * 30)
    model = toxicity.fit(spark, train, train.select("doc_id", F.col("text").rlike("moron").cast("int").alias("toxic")))
    for r in toxicity.score(spark, docs(spark, texts), model).collect():
        words = toxicity.words_of(texts[r["doc_id"]])
        segments = []
        scores = toxicity.scores_of(words, model.tokens)
        for b, e, s in toxicity.maximal_segments(scores):
            assert s == pytest.approx(float(scores[b:e].sum()))
            segments.append(model.k * len(words) * math.exp(-model.lam * s))
        logs = [-math.log(max(v, 1e-300)) for v in segments if v <= toxicity.SIGNIFICANT]
        a, b, c = model.line
        want = 1 / (1 + math.exp(-max(-60, min(60, a + b * max(logs, default=0) + c * math.log1p(sum(logs))))))
        assert r["score"] == pytest.approx(want) and r["n_passages"] == len(logs)


def test_law_sees_every_token_of_clean_texts(spark):
    """lambda over all token scores of the clean texts that calibrate; of 2000 words a stride would leave out most."""
    rnd = random.Random(8)
    plain = [f"{a}{b}" for a in ("ga", "lo", "mi", "tu") for b in ("rden", "cal", "nute", "lip")]
    texts = [" ".join("moron" if rnd.random() < 0.02 else rnd.choice(plain) for _ in range(2000)) for _ in range(60)] + ["you moron idiot scum"] * 60
    own = docs(spark, texts)
    model = toxicity.fit(spark, own, own.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic")))
    second = own.where("doc_id < 60").where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0)
    scores = np.concatenate([toxicity.scores_of(toxicity.words_of(r["text"]), model.tokens) for r in second.collect()])
    values, times = np.unique(np.round(scores, 2), return_counts=True)
    assert values.max() > 0
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (times * np.exp(np.minimum(mid * values, 700))).sum() > times.sum() else (mid, hi)
    assert model.lam == pytest.approx(lo, rel=1e-9)


def test_forward_sums_all_segmentations():
    vocab = ({"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "▁ab": 5}, 6)
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1, 1e-7])[:, None]
    lattice = language_id.Lattice(["▁ab", "▁z"], vocab)
    want = 0.1 * 0.2 * 0.15 + 0.25 * 0.15 + 0.1 * 0.2 + 0.1
    assert np.exp(lattice.log_probability(p)[0, 0]) == pytest.approx(want)
    assert np.exp(lattice.log_probability(p)[1, 0]) == pytest.approx(0.1 * 1e-7)
    expected = lattice.expected(p, np.array([1.0, 0.0]))
    assert expected[5] == pytest.approx(0.1 / want) and expected[3] == pytest.approx(0.25 * 0.15 / want)


def test_words_of_any_length_are_summed_whole():
    """In logarithms as by probabilities, and against a count of segmentations where each piece is as likely as the next."""
    vocab = ({"\u2581": 0, "a": 1, "aa": 2}, 3)
    p = np.array([[0.5, 0.2], [0.3, 0.3], [0.2, 0.4], [1e-7, 1e-7]])
    short = ["\u2581" + "a" * n for n in (1, 5, 30)]
    for w, want in zip(short, language_id.Lattice(short, vocab).log_probability(p)):
        assert language_id.LongWord(w, vocab).forward(np.log(p))[-1] == pytest.approx(want)
        counts = language_id.Lattice([w], vocab).expected(p[:, :1], np.ones(1))
        assert language_id.LongWord(w, vocab).expected(np.log(p[:, :1])) == pytest.approx(counts)
    fib = [1, 1]
    while len(fib) < 3002:
        fib.append(fib[-1] + fib[-2])
    even = np.full((4, 1), 1.0)
    assert language_id.LongWord("\u2581" + "a" * 3000, vocab).forward(np.log(even))[-1, 0] == pytest.approx(float(math.log(fib[3000])))


def test_language_scores_equal_a_word_by_word_version(spark):
    """Repeated, long and odd texts: each score from its words' sums, one word at a time."""
    train = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog " + "z" * 100, "en"), ("der hund und die katze", "de")] * 5)], TEXT)
    langs, p = language_id.fit(spark, train, F.lit(True), docs_per_lang=2)
    path = P.path("piece_bpe_32k.model")
    vocab = language_id.vocabulary(path)
    texts = ["The cat, the dog!", "The cat, the dog!", "\u039f\u03a3 \u03a3\u03a3a \u00b2x", "d" * 80 + " und", "hund  katze\nder " * 3000, "-", "  ", "word" * 30]
    found = language_id.Scorer(langs, p, path).score(texts)
    for t, (lang, score) in zip(texts, found):
        words = ["\u2581" + w for w in language_id.WORDS.findall(t.lower())]
        if not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        total = sum(language_id.LongWord(w, vocab).forward(np.log(p))[-1] for w in words[:200]) if len(words) <= 200 else 3000 * sum(language_id.LongWord(w, vocab).forward(np.log(p))[-1] for w in words[:3])
        assert lang == langs[int(total.argmax())] and score == pytest.approx(float(1 / np.exp(total - total.max()).sum()))


def test_language_id(spark, sf_dir):
    rows = registry.queries()["op1_language_id"](spark, sf_dir)
    right = rows.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first()["x"]
    assert right > 0.95
    train = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)], TEXT)
    langs, p = language_id.fit(spark, train, F.lit(True))
    found = [(r["lang_pred"], r["score"]) for r in language_id.predict(spark, docs(spark, [None, "", "123 ²", "the dog", "und " * 5000, "q" * 500]), langs, p).orderBy("doc_id").collect()]
    assert [f[0] for f in found[:5]] == ["und", "und", "und", "en", "de"] and all(0 <= f[1] <= 1 for f in found)
    assert language_id.predict(spark, docs(spark, ["a"]), [], np.zeros((1, 0))).first()["lang_pred"] == "und"


def brute_classes(texts):
    """Components of all pairs of weighted similarity 0.8 or more, by the smallest number."""
    found, n = near_dedup.shingles([t or "" for t in texts]), len(texts)
    df = {}
    for h, _ in found:
        for x in h.tolist():
            df[x] = df.get(x, 0) + 1
    factor = lambda x: np.clip(math.log((n + 1) / df[x]) / math.log(1 / near_dedup.COMMON), near_dedup.LEAST, 1) if df[x] >= near_dedup.COMMON * n else 1.0
    sets = [(h, c * np.array([factor(x) for x in h.tolist()])) for h, c in found]
    own = list(range(n))
    for i in range(n):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= near_dedup.SIMILAR:
                a, b = sorted((own[i], own[j]))
                own = [a if x == b else x for x in own]
    return own


def test_words_are_hashed_without_a_call_each(monkeypatch):
    """Work in Python grew with the distinct words: now only words longer than 64 bytes are hashed one by one."""
    calls, real = [], near_dedup.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(near_dedup.xxhash, "xxh3_64_intdigest", lambda x: calls.append(1) or real(x))
    near_dedup.shingles([" ".join(f"w{i}x{j}" for j in range(100)) for i in range(30)] + ["a b c d " + "y" * 65])
    assert len(calls) == 1


def test_words_of_any_length_have_their_own_hash():
    """Words that differ in one byte at any place, or in length only, beside others and alone."""
    words = ["", *("a" * n for n in range(1, 140)), *("\0" * n for n in range(1, 140)), *("a" * i + "b" + "a" * (71 - i) for i in range(72)), *("a" * i + "b" + "a" * (15 - i) for i in range(16)), "é" * 4, "é" * 40]
    found = near_dedup.word_hashes(pa.array(words, pa.large_string()))
    assert len(set(found.tolist())) == len(words)
    assert near_dedup.word_hashes(pa.array(words, pa.large_string())[100:200]).tolist() == found[100:200].tolist()
    assert [near_dedup.word_hashes(pa.array([w], pa.large_string()))[0] for w in words] == found.tolist()
    assert len(near_dedup.word_hashes(pa.array([], pa.large_string()))) == 0


def test_shingles_are_runs_of_five_words_with_their_counts():
    """Held against tuples of words: each hash stands for one tuple, in all texts."""
    texts = ["", " ", "one", "one two", "two one", "a b c d e", "a b c d", "a b c d e f a b c d e", "\u2003a b\u00a0c d\te\n", " ".join("pq" * 30), "x" * 65 + " b c d " + "y" * 9, "", "a b c d " + "z" * 64, "é à ü ß ñ", "a b c d e " * 50, ""]
    stands = {}
    for text, (h, c) in zip(texts, near_dedup.shingles(texts), strict=True):
        words = text.split()
        want = {}
        for i in range(max(len(words) - 4, 1) if words else 0):
            want[tuple(words[i : i + 5])] = want.get(tuple(words[i : i + 5]), 0) + 1
        alone = {near_dedup.shingles([" ".join(k)])[0][0].item(): k for k in want}
        assert h.tolist() == sorted(h.tolist()) and {alone[x]: n for x, n in zip(h.tolist(), c.tolist())} == want
        assert all(stands.setdefault(x, k) == k for x, k in alone.items())
    assert len(set(stands.values())) == len(stands) and near_dedup.shingles([]) == []


def test_near_dedup(spark):
    rnd = random.Random(6)
    words = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    base = words(150)

    def changed(ws, k):
        ws = list(ws)
        for _ in range(k):
            ws[rnd.randrange(len(ws))] = f"x{rnd.randint(0, 10**6)}"
        return " ".join(ws)

    texts = [None, "", " ", "one two", "one two", " ".join(base), " ".join(base)] + [changed(base, rnd.randint(0, 8)) for _ in range(40)] + [changed(words(80), 0) for _ in range(30)]
    other = words(60)
    texts += [changed(other, k) for k in (0, 1, 1, 2)]
    found = {r["doc_id"]: r for r in near_dedup.classes(spark, docs(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [found[i]["class_id"] for i in range(len(texts))] == want
    assert all(found[i]["class_size"] == want.count(want[i]) and found[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    kept = near_dedup.kept_rows(spark, docs(spark, texts))
    assert kept.count() == len(set(want)) and "_text" in kept.columns
    assert near_dedup.classes(spark, docs(spark, ["x"]).limit(0)).count() == 0
    lone = docs(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert near_dedup.classes(spark, lone).first()["kept"]


def test_weights_fall_with_document_frequency(spark):
    """Weights as literals: ln(201 / df) / ln(200) for shingles in 1, 8, 100 and 200 of 200 documents, one at most and 0.001 at least."""
    texts = ["p q r s t"] * 8 + ["u v w x y"] * 100 + [f"a{i} b c d e" for i in range(92)]
    weights = near_dedup.common_shingles(spark, docs(spark, texts).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")))
    of = lambda t, w: float(w.of(*near_dedup.shingles([t])[0])[0])
    assert [of(t, weights) for t in (texts[0], texts[8], texts[-1])] == pytest.approx([0.60847, 0.13176, 1.0], abs=1e-4)
    everywhere = near_dedup.common_shingles(spark, docs(spark, ["p q r s t"] * 200).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")))
    assert of("p q r s t", everywhere) == pytest.approx(0.001)


def test_a_template_does_not_make_near_copies(spark):
    """92 of 100 shingles of a template in 4 % of documents: 56.0 / (56.0 + 16) = 0.78, below 0.8; by counts alone it would be 0.85."""
    template = " ".join(f"t{i}" for i in range(96))
    texts = [template + "".join(f" d{i}x{j}" for j in range(8)) for i in range(8)] + [f"f{i} b c d e" for i in range(192)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark, docs(spark, texts)).collect()}
    assert [found[i] for i in range(8)] == list(range(8))


def test_equal_samples_have_equal_bits_whatever_the_weights():
    """A fifth of the shingles counted twice in one document: its signature meets the other's as often as they are similar."""
    rnd = np.random.default_rng(7)
    a = np.sort(rnd.integers(0, 1 << 63, 500).astype(np.uint64))
    wa, wb = np.ones(500), np.ones(500)
    wa[::5], wb[::5], wb[1::50] = 2.0, 2.0, 3.5
    like = near_dedup.similarity((a, wa), (a, wb))
    sampler = near_dedup.Sampler(4000)
    one, two = (sampler.signatures(a, w, np.array([0]))[:, 0] for w in (wa, wb))
    assert np.mean(one == two) == pytest.approx(like, abs=0.02)
    mixed = sampler.signatures(a, np.where(np.arange(500) % 5, wa, 2.0), np.array([0]))[:, 0]
    assert (one == mixed).all()


def test_recall_of_links_over_a_whole_table(spark):
    """sf0.01: of all pairs of documents with similarity 0.8 or more, how many are in one class, against all pairs by brute force."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs_.collect())
    want = brute_classes([t for _, t in rows])
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark, docs_).collect()}
    same = lambda own: {(i, j) for g in {c: [k for k in range(len(rows)) if own[k] == c] for c in set(own)}.values() for i in g for j in g if i < j}
    have, real = same([found[i] for i, _ in rows]), same(want)
    assert have <= real and len(have) / len(real) >= 0.99


def test_prefixes_lose_no_pair(spark):
    """Nodes whose bands leave them apart: every pair of similarity 0.8 or more is among the pairs by first shingles."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(60):
        own = list(base if i % 2 else base[:60] + [f"c{j}" for j in range(60)])
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = f"e{rnd.randint(0, 40)}"
        made.append(" ".join(own[: rnd.randint(95, 120)]))
    texts = spark.createDataFrame(list(enumerate(made)), "_id long, _text string")
    weights = near_dedup.common_shingles(spark, texts)
    sets = [(h, weights.of(h, c)) for h, c in near_dedup.shingles(made)]
    counted = near_dedup.counted_shingles(spark, texts, weights)
    nodes = spark.createDataFrame([(i, float(w.sum()), float(w.sum()), None, 0.0, i) for i, (_, w) in enumerate(sets)], "n long, w double, v double, p long, s_ double, c long")
    other = [F.col("w").alias("pw"), F.col("v").alias("pv"), F.col("p").alias("pp"), F.col("s_").alias("ps")]
    found = {tuple(sorted((r["a"], r["b"]))) for r in near_dedup.prefix_pairs(counted, nodes, F.lit(True), other).collect()}
    linked = {(i, j) for j in range(60) for i in range(j) if near_dedup.similarity(sets[i], sets[j]) >= 0.8}
    assert linked and linked <= found and len(found) < 60 * 59 / 2


def test_samples_meet_as_often_as_sets_are_similar():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = np.sort(pool[:200]), np.sort(pool[60:260])
    wa, wb = np.full(200, 1.0), np.full(200, 1.0)
    wa[::3] = 2.5
    like = near_dedup.similarity((a, wa), (b, wb))
    sampler = near_dedup.Sampler(2000)
    met = np.mean(sampler.signatures(a, wa, np.array([0]))[:, 0] == sampler.signatures(b, wb, np.array([0]))[:, 0])
    assert met == pytest.approx(like, abs=0.04)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (30, 20), (4, 4)] + [(i, i + 1) for i in range(100, 140)]
    found = {r["_id"]: r["_root"] for r in near_dedup.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [found[i] for i in (1, 2, 3, 4, 10, 11, 12, 20, 30, 140)] == [1, 1, 1, 1, 10, 10, 10, 20, 20, 100]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.fetchall())


def test_stages_leave_columns_of_any_name_alone(spark):
    """Every stage over documents whose other columns are named as the operators name theirs inside; null, empty, repeated and long texts among them."""
    names = ["_id", "_ID_", "_kept", "_gone", "_keep", "_sha", "_hash", "_text", "_norm", "_part", "_entry", "start", "_prints", "score", "class_id", "kept"]
    passage = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", "a b", "a  b", passage, passage + " end", "x " * 60_000, None, "fine words", passage.upper()]
    own = spark.createDataFrame([(i % 9, t, None, "s", 0, *range(len(names))) for i, t in enumerate(texts)], TEXT + "".join(f", `{n}` int" for n in names))
    stages = [lambda d: exact_dedup.kept_rows(spark, d), lambda d: near_dedup.kept_rows(spark, d), lambda d: suffix_dedup.trimmed_rows(spark, d), lambda d: toxicity.kept_rows(spark, d, toxicity.Model({}, {}, -1.0))]
    for stage in stages:
        for rows in (own, own.where("doc_id > 0")):
            done = stage(rows)
            assert done.columns == own.columns
            assert 0 < done.count() <= len(texts) and done.select(*(f"`{n}`" for n in names)).distinct().collect() == own.select(*(f"`{n}`" for n in names)).distinct().collect()
        assert stage(own.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage against brute force over what it was given."""
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = given.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in given.collect()}
        stage(spark, given, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.dtypes == columns
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "exact dedup":
            groups = {}
            for i, t in sorted(before.items()):
                groups.setdefault(regex.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            assert set(left) == set(groups.values())
        if name == "near-dedup":
            order = sorted(before)
            own = brute_classes([before[i] for i in order])
            assert set(left) == {order[k] for k in set(own)}
        if name == "suffix-array dedup":
            order = sorted(before)
            cut = repeats([(before[i] or "").encode() for i in order])
            assert all((left[i] == before[i]) == (c[1] == 0) for i, c in zip(order, cut))
        if name == "toxicity":
            assert len(left) > 0.8 * len(before)
        given = after


def test_run_equals_its_stages_and_leaves_one_table(spark, sf_dir, tmp_path, monkeypatch):
    """run() against the chain of stages written by hand; a second start of a stage takes nothing from a lazy result."""
    import corpus_pipeline
    from silvergrain.llm import shared

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lazy = corpus_pipeline.exact(spark, given, sf_dir)
    corpus_pipeline.exact(spark, given, sf_dir)
    corpus_pipeline.near(spark, given, sf_dir)
    assert 0 < lazy.count() < given.count()
    with shared.noted() as made:
        found = corpus_pipeline.run(spark, sf_dir)
    rows = sorted(map(tuple, found.collect()))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, sf_dir).write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
    assert rows == sorted(map(tuple, given.select(found.columns).collect())) and rows
    there = [p for p in made if shared._placed(spark, p)[1].exists(shared._placed(spark, p)[0])]
    assert [p for p in there if "/pipeline-" in p] == [p for p in made if "/pipeline-packing" in p]


def test_ship_leaves_what_is_set(spark):
    from silvergrain.llm import shared

    kept = spark.conf.get(shared.BATCH)
    spark.conf.set(shared.BATCH, "10000")
    shared.ship(spark)
    assert spark.conf.get(shared.BATCH) == "10000"
    spark.conf.unset(shared.BATCH)
    shared.ship(spark)
    assert spark.conf.get(shared.BATCH) == str(shared.BATCH_ROWS)
    spark.conf.set(shared.BATCH, kept)


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Null, empty, repeated and long rows, rows without ids, further columns with names that stages use; and no rows at all."""
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(90))
    rows = [(1, None), (2, ""), (3, words), (3, words), (4, words + " more"), (5, "x " * 50_000), (None, "alone here"), (None, words), (6, " ")]
    own = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], TEXT + ", _id int, score int")
    spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given, ids in ((own, [None, 1, 3, 5]), (own.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, given, str(tmp_path))
            assert name == "packing" or done.columns == own.columns
            done.write.mode("overwrite").parquet(f"{tmp_path}/{len(ids)}-{name}")
            given = spark.read.parquet(f"{tmp_path}/{len(ids)}-{name}")
        assert sorted({r["doc_id"] for r in given.collect()}, key=lambda i: i or 0) == ids


def test_stages_row_by_row(spark, sf_dir):
    """Toxicity against the model's score of each text, trimmed texts against brute-force bytes, pieces against the library's ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    model = toxicity.fit(spark, given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {i for i, t in texts.items() if model.score(*model.evidence(t)[:2]) < toxicity.DECISION}
    assert {r["doc_id"] for r in stages["toxicity"](spark, given, sf_dir).collect()} == clean != set(texts)
    order = sorted(texts)
    want = {i: c[3] for i, c in zip(order, repeats([(texts[i] or "").encode() for i in order]))}
    left = {r["doc_id"]: r["text"] for r in stages["suffix-array dedup"](spark, given, sf_dir).collect()}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in left.items()} == want
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    seen = dict.fromkeys(ids, 0)
    for r in stages["packing"](spark, given, sf_dir).orderBy("doc_id", "start").collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.asarray(piece, "<u4").tobytes())
        seen[r["doc_id"]] += len(piece)
    assert seen == {i: len(x) for i, x in ids.items()}
