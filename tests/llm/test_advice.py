"""Whole results where earlier versions left something out."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tellsift.llm import chat, neardup, packing, topk
from tellsift.llm.queries import tool_messages


def test_pruning_loses_less_than_the_stated_share():
    at, lost, p = 0, 0.0, np.zeros(neardup.BANDS * neardup.ROWS + 1)
    p[0] = 1.0
    for n, least in neardup.needed_matches(0.75):
        for _ in range(n - at):
            p = p * 0.25 + np.concatenate([[0.0], p[:-1]]) * 0.75
        at, lost = n, lost + p[:least].sum()
        p[:least] = 0
    assert lost + (1 - 0.75**neardup.ROWS) ** neardup.BANDS < 1.2e-5


def test_top_k_takes_large_components(spark):
    big = float(1 << 44)
    near = [(i, [float(i - 20), 1.0]) for i in range(1, 40)] + [(50, [9e6, 2.0]), (51, [-9e6, 3.0])]
    cancelling = [(100, [big, big]), (101, [-big, big + 2.0**-8])]  # products of 2**104 leave 2**52
    for rows, asked, k in ((near, (50, 20), 4), (cancelling, (100, 101), 1)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
        got = topk.top_k(df, df.where(F.col("vec_id").isin(list(asked))), k=k, block=4, segment=16).collect()
        want = set()
        for q in asked:
            best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), df.limit(0)).collect()


def test_exact_integer_products():
    big = 1 << 58
    left, right = np.array([[big, big]]), np.array([[-big, big + 65536], [big, -big]])
    assert topk.products(left, right).tolist() == [[65536 * big, 0]]
    assert topk._best(topk.products(left, right)[0], np.array([7, 8]), 1).tolist() == [0]


def test_calls_behind_a_circle_are_circular(spark):
    rows = [("z", 1, ["z2"]), ("z2", 2, ["z"]), ("w", 3, ["z"]), ("v", 5, ["w"]), ("a", 1, ["b"]), ("b", 4, []), ("c", 6, ["b", "nobody"])]
    calls = spark.createDataFrame([(1, *r) for r in rows], "conv long, call string, at long, needs array<string>")
    got = {r.call: r.level for r in chat.call_order(calls).collect()}
    assert got == {"z": -1, "z2": -1, "w": -1, "v": -1, "a": 1, "b": 0, "c": 0}


def test_tool_messages_need_later_calls_and_stand_in_circles(spark, sf):
    made = tool_messages(spark, sf.replace("sf0.001", "sf0.01")).where("call_id is not null")
    calls = made.select("conv_id", F.substring("call_id", 2, 20).cast("long").alias("turn"), F.explode("needs").alias("need"))
    calls = calls.withColumn("need", F.substring("need", 2, 20).cast("long")).collect()
    met = {(r.conv_id, r.turn, r.need) for r in calls}
    assert any(n > t for _, t, n in met) and any((c, n, t) in met for c, t, n in met)


def test_certified_partitions_exchange_their_last_sequences(spark):
    # pieces of length 1: every partition meets its bound and leaves a sequence partly filled
    pieces = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id long, length long")
    packed = packing.pack_pieces(pieces, 64, part_items=200).cache()
    assert packing.sequences_and_bound(packed, 64) == (16, 16)
    used = defaultdict(list)
    for r in packed.collect():
        used[r.sequence_id].append((r.offset, r.length))
    assert sum(len(x) for x in used.values()) == 1000
    for places in used.values():
        assert [o for o, _ in sorted(places)] == list(range(len(places))) and len(places) <= 64


def test_pipeline_near_duplicates_against_brute_force(spark):
    from test_operators import brute_components

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    alone = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join(near), *alone, alone[0], alone[1], alone[1], " ".join(base)]
    ids = [7, 5, None, 9, 9, None, 3, 4, 6, 8, None, None, None, 9]
    rows = [(i, t, "en", "a", k) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    groups = defaultdict(list)
    for k, root in enumerate(brute_components(texts)[0]):
        groups[root].append((ids[k] is None, ids[k] or 0, k))
    want = Counter((ids[k], texts[k]) for *_, k in (min(g) for g in groups.values()))
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
