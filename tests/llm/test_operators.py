"""Operators against brute force, and the cases every operator must take: nulls, blanks, ties, clashes."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tellsift.llm import (
    chat, hashing, language_id, lm_scoring, mixing, neardup, packing, quality_rules, resampling, sharding, topk,
)
from tellsift.llm.components import components
from tellsift.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, _id string"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank and long texts, repeated rows and ids, columns with the operators' own names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "été"]) + str(rng.randint(0, 400)) for _ in range(30_000))
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, text, "en", "a", 1, "x", 1, "q"), (2, text, "en", "a", 1, "x", 1, "q"), (2, text, "en", "a", 1, "x", 1, "q"),
        (3, text.upper() + " fourteen", "en", None, 1, None, None, None), (3, "another text of one name", None, "b", 1, "x", 1, "q"),
        (4, None, "en", "a", 1, "x", 1, "q"), (5, "", "fr", "b", None, "x", 1, "q"), (6, " \t\n\x0b\f\r ", "fr", "b", 1, "x", 1, "q"),
        (None, text, None, None, None, None, None, None), (7, long, "fr", "b", 1, "x", 1, "q"), (8, "  é 中 ...", "fr", "c", 1, "x", 1, "q"),
        (9, "a a a a a a a a a a a a", "fr", "c", 1, "x", 1, "q"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (9, 0), (9, None), (None, 0), (4, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["z" * 200, "q" * 90 + " " + "r" * 90, None, "", " A\tb\x0bA "]
    seen = {}
    for limit in (1 << 20, 16):
        old, hashing.SLICE = hashing.SLICE, limit
        try:
            for first, counts, found in hashing.word_groups(pa.array(texts), limit):
                at = 0
                for i, n in enumerate(counts.tolist()):
                    expected = words(texts[first + i])
                    assert len(expected) == n
                    for w, h in zip(expected, found[at : at + n].tolist()):
                        assert seen.setdefault(w, h) == h
                    at += n
        finally:
            hashing.SLICE = old
    assert len(set(seen.values())) == len(seen)


def test_shards(spark, odd, none, tmp_path):
    rows = sorted(sharding.shard_by_size(odd, 3).collect(), key=lambda r: (r.shard, r.slot))
    assert len(rows) == odd.count()
    total, start = sum(r["size"] for r in rows), 0
    for r in rows:
        assert r.shard == start * 3 // total
        start += r["size"]
    for _, group in groups(rows, "shard").items():
        assert [r.slot for r in group] == list(range(len(group)))
    assert rows[0].doc_id is None
    assert {r.text_crc32 for r in rows if r.doc_id in (4, 5)} == {0}
    assert sharding.shard_by_size(none, 3).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(odd.columns).exceptAll(odd).count() == 0 and back.count() == odd.count()


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_mix(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 3 * r["size"] and r["size"] == len(words(dict_text(odd)[(r.doc_id, r.source, r["size"])])) for r in rows)
    sources = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    assert all(t <= 3 * s for s, t in sources.values())
    repeated = mixing.repeat_rows(odd)
    assert repeated.columns == odd.columns and repeated.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.repeat_rows(none).count() == 0


def dict_text(df):
    return {(r.doc_id, r.source, len(words(r.text))): r.text for r in df.collect()}


def test_water_filling_matches_rounds(spark):
    rng = random.Random(3)
    sizes = {f"s{i:02d}": rng.choice([0, 5, 40, 1000, 90_000]) for i in range(40)}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size long, _rows long")
    got = {r.source: r.target for r in mixing.source_targets(df, "source").collect()}
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(sorted(sizes))}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [k for k in sizes if k not in capped]
        rest, sum_w = total - sum(capped.values()), sum(weight[k] for k in free)
        over = {k: 3 * sizes[k] for k in free if rest * weight[k] / sum_w >= 3 * sizes[k]}
        if not over:
            break
        capped.update(over)
    for k in sizes:
        assert got[k] == pytest.approx(capped.get(k, rest * weight[k] / sum_w if free else 0))


def test_packing(spark, docs, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    frame = spark.createDataFrame([d[:2] for d in docs[:60]], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack_documents(frame, tokenizer_path(), capacity=256, with_ids=True).collect()
    expected = Counter()
    for r in frame.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            raw = np.array(ids[k : k + 256], dtype="<u4").tobytes()
            expected[(r.doc_id, k // 256, k, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == expected
    for group in groups(rows, "sequence_id").values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:i]) for i in range(len(group))]
        assert sum(r.length for r in group) <= 256
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_packing_rounds_and_bounds(spark):
    rng = random.Random(8)
    lengths = np.array([rng.randint(1, 60) for _ in range(400)])
    bins, _, fill = packing.best_fit_decreasing(-np.sort(-lengths), 64)
    assert fill.max() <= 64 and packing.lower_bound(lengths, 64) <= len(fill)
    assert packing.lower_bound(np.array([33] * 10), 64) == 10
    assert packing.lower_bound(np.array([22] * 9), 64) == 5
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack_pieces(pieces, 64, part_items=40).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64 and packing.lower_bound(lengths, 64) <= len(used) <= len(fill) * 1.05 + 3


def test_language(spark, docs, odd, none):
    learn = spark.createDataFrame([d for d in docs if d[0] % 2], "doc_id long, text string, lang string, source string")
    test = spark.createDataFrame([d for d in docs if d[0] % 2 == 0], "doc_id long, text string, lang string, source string")
    model = language_id.train(learn)
    truth = {d[0]: d[2] for d in docs}
    rows = language_id.predict(test, model).collect()
    assert len(rows) == test.count() and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert got[4] == got[5] == got[6] == "und" and got[8] in truth.values()
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_signs_are_no_letters(spark, docs):
    learn = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    signs = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460 12"), (2, "\u00b2 the")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(signs, language_id.train(learn)).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_language_filter_counts_every_member():
    gram = np.arange(5000, dtype=np.int64) + (3 << 40)
    model = language_id.LanguageFilter([f"l{i}" for i in range(11)], np.arange(5000) % 11, gram)
    masks = [np.bitwise_and.reduce([plane[s] for s in model.places(gram.astype(np.uint64))]) for plane in model.planes]
    assert all((masks[(i % 11) >> 3][i] >> ((i % 11) & 7)) & 1 for i in range(5000))
    assert model.false_rate.max() < 0.01


def test_quality_statistics(odd, none):
    rows = quality_rules.text_statistics(odd).collect()
    for r in rows:
        w = (r.text or "").encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if many[g] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(covered))
        assert r.n_symbols == sum((r.text or "").count(s) for s in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
    assert quality_rules.text_statistics(none).count() == 0


def test_quality_rules(spark, sf, odd, none, marks):
    judged = quality_rules.judge(odd, marks, with_rows=True)
    by_id = groups(judged.collect(), "doc_id")
    assert by_id[4][0].base_failed and by_id[9][0].base_failed and by_id[1][0].kept
    assert judged.select("row.*").columns == odd.columns and judged.count() == odd.count()
    assert quality_rules.judge(none, marks).count() == 0
    assert quality_rules.judge(odd, marks.limit(0)).count() == odd.count()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.judge(docs, labels).join(labels, "doc_id").select("quality", "base_failed", "kept").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)


def test_learned_list_finds_the_planted_rules(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        x, y = rng.random(), rng.random()
        rows.append((x, y, x > 0.8 or (y > 0.5 and x < 0.2), rng.random() < 0.66))
    df = spark.createDataFrame(rows, "x double, y double, _bad boolean, _grow boolean")
    found = quality_rules.learn_rules(df, features=("x", "y"), precision=0.9)
    wrong = df.where(found.kept() == F.col("_bad")).count()
    assert len(found.rules) >= 2 and wrong < 0.08 * len(rows)


def test_resampling(spark, sf, odd, none, marks):
    got = resampling.resample(odd, marks)
    assert got.count() == odd.count()
    assert {r.log_weight for r in got.where("doc_id in (4, 5, 6)").collect()} == {0.0}
    assert resampling.resample(odd, marks.limit(0)).where("sampled").count() == odd.count()
    assert resampling.resample(none, marks).count() == 0
    carried = resampling.resample(odd, marks, with_rows=True)
    assert carried.select("row.*").exceptAll(odd).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = resampling.resample(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.sampled for r in good]) > 0.98 > np.mean([r.sampled for r in bad])
    assert np.mean([g.gumbel_key > b.gumbel_key for g in good for b in bad]) > 0.95


def test_log_weights_match_brute_force(spark, docs):
    ratios = np.linspace(-1, 1, resampling.BUCKETS)
    some = docs[:20]
    got = {r.doc_id: r.log_weight for r in resampling.log_weights(spark.createDataFrame([d[:2] for d in some], "doc_id long, text string"), ratios, ("doc_id",)).collect()}
    for i, text, *_ in some:
        (_, counts, tokens), = hashing.word_groups(pa.array([text]), 1 << 24, classes=True)
        pairs = [hashing.mix(tokens[k : k + 1] * np.uint64(3) + tokens[k + 1 : k + 2])[0] for k in range(len(tokens) - 1)]
        assert got[i] == pytest.approx(sum(ratios[int(t) % resampling.BUCKETS] for t in [*tokens, *pairs]), abs=1e-6)


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([0.5, rng.gauss(0, 1), rng.gauss(0, 1e-9)]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert resampling.kth_largest(df, "v", k, bins=16) == sorted(values, reverse=True)[min(k, 1000) - 1]


def test_lm_scores(spark, docs, odd, none):
    held = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 1}
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model, tail = lm_scoring.train(frame.where(~F.col("doc_id").isin(list(held))), filter_bits=24)
    counts = Counter()
    for i, text, *_ in docs:
        if i not in held:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in lm_scoring.score(frame, model, tail).collect()}
    for i, text, *_ in docs:
        tokens = [*words(text), None]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
    assert lm_scoring.score(odd, model, tail).count() == odd.count()
    assert lm_scoring.score(none, model, tail).count() == 0
    empty, rest = lm_scoring.train(none, filter_bits=20)
    assert {r.n_known for r in lm_scoring.score(odd, empty, rest).collect()} == {0}


def test_lm_head_and_tail_agree(spark, docs, monkeypatch):
    frame = spark.createDataFrame([d[:2] for d in docs[:60]], "doc_id long, text string")
    whole = lm_scoring.score(frame, *lm_scoring.train(frame, filter_bits=22)).orderBy("doc_id").collect()
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 50)
    parted = lm_scoring.score(frame, *lm_scoring.train(frame, filter_bits=22)).orderBy("doc_id").collect()
    for a, b in zip(whole, parted):
        assert a.n_known == b.n_known and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)


def test_lm_probabilities_sum_to_at_most_one(spark, docs):
    frame = spark.createDataFrame([d[:2] for d in docs[:40]], "doc_id long, text string")
    model, _ = lm_scoring.train(frame, filter_bits=24)
    vocabulary = model.head_words
    for first in range(0, len(vocabulary), max(1, len(vocabulary) // 25)):
        before = np.full(len(vocabulary), first)
        total = (10 ** lm_scoring.model_log10(model, vocabulary, np.arange(len(vocabulary)), before)).sum()
        assert 0.3 < total < 1.02


def test_lm_filter_holds_every_ngram(spark, docs, monkeypatch):
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    single, double, held = Counter(), Counter(), Counter()
    texts = pa.array([d[1] for d in docs])
    for _, _, tokens, before in lm_scoring.token_groups(texts):
        single.update(tokens.tolist())
        double.update(lm_scoring.pair_keys(before, tokens).tolist())
    double = {k: n for k, n in double.items() if n >= 2}
    for k, n in double.items():
        held[k >> 32] += n
    whole = lm_scoring.score(frame, *lm_scoring.train(frame)).orderBy("doc_id").collect()
    monkeypatch.setattr(lm_scoring, "SEGMENT_BITS", 14)
    monkeypatch.setattr(lm_scoring, "ASKED_TOKENS", 50)
    model, tail = lm_scoring.train(frame, filter_bits=14)
    assert model.segments > 8 and model.false_mass <= lm_scoring.FALSE_MASS
    for counts, tag, least, half in ((single, "WORD", "word", True), (double, "PAIR", "pair", False), (held, "HELD", "held", True)):
        keys = np.array(list(counts), dtype=np.uint64)
        spots = keys & np.uint64(0xFFFFFFFF) if half else keys
        right = np.floor(np.log(np.array(list(counts.values())) / lm_scoring.LEAST[least]) / np.log(lm_scoring.BASE) + 1e-9) + 1
        found = model.filter.levels(keys ^ getattr(lm_scoring, tag), spots)
        assert (found >= right).all() and (found == right).mean() > 0.97
    parted = lm_scoring.score(frame, model, tail).orderBy("doc_id").collect()
    assert [r.doc_id for r in parted] == [r.doc_id for r in whole]
    for a, b in zip(whole, parted):
        assert a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score, rel=0.02)


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def drifting(n, rng):
    """Copies that change a word at a time, so that far ones are linked only through those between."""
    base = [f"w{i}" for i in range(70)]
    out = []
    for _ in range(n):
        if rng.random() < 0.4:
            base = [*base]
            base[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
        copy = [*base]
        if rng.random() < 0.5:
            copy[rng.randrange(70)] = f"y{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates(spark, docs, odd, none):
    rng = random.Random(6)
    texts = [d[1] for d in docs] + drifting(150, rng) + ["a b", "A  b", "", None, "one", "a a a a a a", "a a a a a a a a a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, sizes = brute_components(texts)
    for options in ({}, {"small": 3, "block": 16}):
        rows = {r.doc_id: r for r in neardup.near_duplicates(frame, **options).collect()}
        assert [rows[i].component_id for i in range(len(texts))] == roots
        assert [rows[i].n_shingles for i in range(len(texts))] == sizes
        assert all(rows[i].kept == (roots[i] == i) for i in range(len(texts)))
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert [r.component_id for r in found if r.doc_id == 2] == [1, 1]
    assert {r.component_id for r in found if r.doc_id == 3} == {1, 3}
    assert all(not r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0


def test_needed_matches_rise_with_the_threshold():
    low, high = neardup.needed_matches(0.5), neardup.needed_matches(0.9)
    assert all(a[1] < b[1] for a, b in zip(low, high)) and high[-1][0] == neardup.BANDS * neardup.ROWS


def test_components(spark):
    rng = random.Random(2)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(150)] + [(ids[200], x) for x in ids[201:260]] + [(5, 5)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {rows[x] for x in ids[:151]} == {min(ids[:151])} and {rows[x] for x in ids[200:260]} == {min(ids[200:260])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(6)], i) for i in range(300)]
    rows += [(300, rows[0][1], 0), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (400, [float("nan")] * 6, 0), (450, None, 0), (None, rows[1][1], 0), (500, [], 0), (501, [], 0), (550, [0.1] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, block=8, segment=64, query_batch=3).collect()
    valid = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for q, v in valid:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q and len(w) == len(v))[:4]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == expected and len(got) == len(expected)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


CALLS = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, needs array<string>, result_of string, level int"


def test_chat(spark):
    tools = {"add": (chat.Field("a", "integer", least=0, most=9), chat.Field("note", "string", required=False, most=3))}
    rows = [
        (1, 0, "user", "hi", None, None, None, None, None, 0),
        (1, 3, "assistant", None, "x", "add", '{"a": 1, "note": "ok"}', [], None, 0),
        (1, 1, "tool", "early", None, None, None, None, "x", 0),
        (1, 2, "assistant", "", "y", "add", '{"b":{"d":1,"c":2}, "a": 12}', ["x"], None, 0),
        (1, 4, "assistant", None, "z", "sub", "{}", ["z2"], None, 0), (1, 5, "assistant", None, "z2", "add", "nope", ["z"], None, 0),
        (1, 6, "tool", "lost", None, None, None, None, "q", 0), (1, 7, "assistant", None, "x", "add", '{"a": "1"}', None, None, 0),
        (1, 8, "tool", "late", None, None, None, None, "x", 0), (2, 0, "tool", "other", None, None, None, None, "x", 0),
        (None, None, None, None, "x", None, None, None, None, None), (None, 1, "user", None, None, None, None, None, None, 1),
    ]
    df = spark.createDataFrame(rows, CALLS)
    out = chat.link_tool_calls(df, tools).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert (got[1, 3].status, got[1, 1].status, got[1, 8].status, got[1, 7].status) == ("ok", "ok", "repeated", "repeated")
    assert (got[1, 2].status, got[1, 2].errors, got[1, 2].level, got[1, 2].anchor) == ("invalid", "a: range; b: unknown", 1, 3)
    assert got[1, 4].status == got[1, 5].status == "circular" and got[1, 5].errors == "arguments: not an object"
    assert got[1, 4].errors == "tool: unknown" and got[1, 7].errors == "a: type"
    assert got[1, 6].status == got[2, 0].status == "orphan" and got[1, 0].status == "plain"
    parsed = json.loads(got[1, 2].json)
    assert got[1, 2].json == json.dumps(parsed, sort_keys=True, separators=(",", ":")) and parsed["arguments"]["b"] == {"c": 2, "d": 1}
    order = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.anchor, r.level, r.call_id or "", r["rank"], r.turn))
    turns = [r.turn for r in order]
    assert turns.index(3) < turns.index(1) and turns.index(3) < turns.index(2)
    assert chat.link_tool_calls(df.limit(0), tools).count() == 0


def test_pipeline_stages_take_odd_rows(spark, sf, odd, none):
    for frame in (odd, none):
        kept = frame
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf)
            if name != "packing":
                assert kept.columns == corpus_pipeline.COLUMNS
                kept = spark.createDataFrame(kept.collect(), kept.schema)
        kept.count()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "mixing", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = corpus_pipeline.rules(spark, docs, sf)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    clean = [r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1 and len(words(r.text)) >= 10]
    assert np.mean([i in kept for i in clean]) > 0.97
    rows = corpus_pipeline.run(spark, sf).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and set(r.doc_id for r in rows) <= kept


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
