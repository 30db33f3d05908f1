"""Near duplicates: MinHash bands for candidates, Bayesian pruning of signatures, exact verification.

1. Every text is reduced to its set of word shingles. Texts with equal sets form a class, and only the
   classes' representatives go on, so copies cost one row each.
2. 32 bands of 4 minima deal the representatives to buckets. At similarity 0.75 a pair shares no bucket
   with probability 5e-6.
3. Pairs are verified in two steps. Signatures are compared 16 values at a time; a pair is pruned once
   the posterior probability (uniform prior) of reaching the threshold falls under ``MISS``. Survivors
   are compared on their full shingle sets, and only that makes a link. A pruned pair isn't looked at
   again: at similarity 0.75 that is a pair in 6.3e-6, so bands and pruning together lose 1.2e-5 of such
   pairs; at 0.78 it is 7e-7.
4. A bucket isn't expanded into all pairs. Each member meets pivots first; links found so join
   components. Then only pairs that lie in different components and haven't been compared are left:
   small buckets list them, large ones compare blocks of ``BLOCK`` members with blocks, and stop
   comparing two components once a link joins them. So every pair in a bucket has been compared or
   is already connected.

Shingles are 64-bit hashes; two shingles of a pair of texts collide with probability under 1e-12.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tellsift.llm.common import cut_lineage
from tellsift.llm.components import components
from tellsift.llm.hashing import mix, word_groups

WIDTH = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-6
SMALL = 48
BLOCK = 2048
_ODD = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
_PERMUTE = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = WIDTH):
    """The sorted distinct shingles of each row; fewer words than ``width`` make one shingle, none make none."""
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * _ODD[i]
    rolled = mix(rolled)
    ends = np.cumsum(counts)
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            found = np.sort(rolled[end - n : end - width + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif n:
            yield mix((words[end - n : end] * _ODD[8 : 8 + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``shingles`` under BANDS * ROWS multiplications, their upper 32 bits."""
    least = np.full(len(_PERMUTE), ~np.uint64(0), dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _PERMUTE).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sign: np.ndarray) -> np.ndarray:
    parts = sign.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key + parts[:, i])
    return key


def needed_matches(threshold: float, miss: float = MISS, size: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) < ``miss``."""
    table = []
    for n in range(batch, size + 1, batch):
        below, m = 0.0, 0
        while True:  # P(S >= t | m of n, uniform prior) = P(Binomial(n + 1, t) <= m)
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        table.append((n, m))
    return table


def _fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: _id, n_shingles, a 128-bit fingerprint of its set, and its band keys."""

    def run(batches):
        for batch in batches:
            for first, counts, words in word_groups(batch.column(1)):
                sizes, one, two, bands = [], [], [], []
                for shingles in shingle_sets(words, counts):
                    sizes.append(len(shingles))
                    x, y = _set_prints(shingles)
                    one.append(x)
                    two.append(y)
                    bands.append(band_keys(signature(shingles)).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
                columns = [
                    batch.column(0).slice(first, len(counts)), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "_one", "_two", "_bands"])

    schema = "_id long, n_shingles long, _one long, _two long, _bands array<long>"
    return df.select(F.col(key).cast("long"), text).mapInArrow(run, schema)


def _set_prints(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    if not len(shingles):
        return 0, 0
    return int(mix(shingles).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(shingles + np.uint64(77))).view(np.int64))


def _sets(df: DataFrame, text: str) -> DataFrame:
    """(_id, n_shingles, fingerprint, signature, shingles) of rows (_id, text)."""

    def run(batches):
        for batch in batches:
            for first, counts, words in word_groups(batch.column(1)):
                sets = list(shingle_sets(words, counts))
                prints = [_set_prints(s) for s in sets]
                columns = [
                    batch.column(0).slice(first, len(counts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in prints], pa.int64()), pa.array([y for _, y in prints], pa.int64()),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "_one", "_two", "_sign", "_set"])

    schema = "_id long, n_shingles long, _one long, _two long, _sign binary, _set binary"
    return df.select("_id", text).mapInArrow(run, schema)


def _similar(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """threshold[1] * common >= threshold[0] * union, on sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * threshold[1] < len(b) * threshold[0]:
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return threshold[1] * both >= threshold[0] * (len(a) + len(b) - both)


def _all_similar(one: np.ndarray, others: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """``_similar`` of one set with each of several, none of them empty."""
    sizes = np.array([len(o) for o in others])
    joined = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    both = np.add.reduceat((one[place] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
    return threshold[1] * both >= threshold[0] * (len(one) + sizes - both)


def _survivors(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows whose signatures may still reach the threshold."""
    live, matches, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, least in needed:
        matches = matches + (left[live, done:n] == right[live, done:n]).sum(axis=1)
        keep = matches >= least
        live, matches, done = live[keep], matches[keep], n
    return live


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that are links: signatures first, then full sets of the survivors."""
    needed = needed_matches(threshold[0] / threshold[1])

    def side(column, *what):
        return sets.select(F.col("_node").alias(column), *[F.col(w).alias(f"{w}_{column}") for w in what])

    def prune(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            kept = pa.array(_survivors(left, right, needed))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    def compare(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), threshold)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signed = pairs.join(side("a", "_sign"), "a").join(side("b", "_sign"), "b")
    left = cut_lineage(signed.select("a", "b", "_sign_a", "_sign_b").mapInArrow(prune, "a long, b long"))
    full = left.join(side("a", "_set"), "a").join(side("b", "_set"), "b")
    return cut_lineage(full.select("a", "b", "_set_a", "_set_b").mapInArrow(compare, "a long, b long"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return members.join(known, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their root and the bucket's size."""
    rooted = _with_roots(members, roots)
    open_ = rooted.groupBy("_key").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n"))
    return cut_lineage(rooted.join(open_.where("_lo != _hi").select("_key", "_n"), "_key"))


def _in_blocks(mixed: DataFrame, sets: DataFrame, threshold: tuple[int, int], block: int) -> DataFrame:
    """Links between components in large buckets.

    A bucket's largest component stays; the members of all others visit every block of the bucket. Both
    sides are cut into blocks by hash, so a group holds about two blocks whatever the bucket's size. A pair
    that shares several buckets is compared in the one of its first band only.
    """
    needed = needed_matches(threshold[0] / threshold[1])
    sizes = mixed.groupBy("_key", "_root").agg(F.count("*").alias("_c"))
    main = sizes.groupBy("_key").agg(F.max(F.struct("_c", F.col("_root").alias("_main"))).alias("_m"), F.sum("_c").alias("_all"))
    main = main.select("_key", "_m._main", F.ceil(F.col("_all") / block).cast("int").alias("_across"), F.ceil((F.col("_all") - F.col("_m._c")) / block).cast("int").alias("_down"))
    told = mixed.join(main, "_key")
    place = lambda salt, n: F.pmod(F.xxhash64("_node", F.lit(salt)), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = told.select("_key", place(1, "_across").alias("_x"), span("_down").alias("_y"), "_node", "_root", F.lit(False).alias("_visits"))
    guests = told.where("_root != _main").select("_key", span("_across").alias("_x"), place(2, "_down").alias("_y"), "_node", "_root", F.lit(True).alias("_visits"))
    dealt = home.unionByName(guests).join(sets, "_node")

    def run(table: pa.Table) -> pa.Table:
        visits = np.array(table["_visits"].to_pylist(), dtype=bool)
        ids, roots = table["_node"].to_numpy(), table["_root"].to_numpy()
        signs = np.frombuffer(b"".join(table["_sign"].to_pylist()), dtype=np.uint32).reshape(len(ids), -1)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table["_set"].to_pylist()]
        bands = np.array([band_keys(x) for x in signs])
        band = int(np.flatnonzero(bands[0] == np.uint64(table["_key"][0].as_py() & ((1 << 64) - 1)))[0])
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        stay, a, b = np.flatnonzero(~visits), [], []
        for g in np.flatnonzero(visits).tolist():
            other = stay[(roots[stay] != roots[g]) & ((bands[stay] == bands[g]).argmax(axis=1) == band)]
            live = other[_survivors(np.broadcast_to(signs[g], (len(other), signs.shape[1])), signs[other], needed)]
            for at in range(0, len(live), 64):
                own = top(int(roots[g]))
                some = [o for o in live[at : at + 64].tolist() if top(int(roots[o])) != own]
                if not some:
                    continue
                for o in np.array(some)[_all_similar(sets[g], [sets[o] for o in some], threshold)].tolist():
                    x, y = top(int(roots[g])), top(int(roots[o]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        a.append(int(ids[g]))
                        b.append(int(ids[o]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("_key", "_x", "_y").applyInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD,
    small: int = SMALL, block: int = BLOCK,
) -> DataFrame:
    """Per row: ``key``, n_shingles, component_id and kept (``key`` = component_id).

    Rows are linked whose sets of 5-word shingles have common / union >= threshold[0] / threshold[1];
    component_id is the smallest key reachable. Null, empty and blank texts have no shingle and are linked
    with nothing; fewer than 5 words are one shingle. Rows without a key take no part: component_id null,
    kept false. Rows with equal keys are separate documents that share a name. Empty table: no rows.
    """
    narrow = cut_lineage(_fingerprints(df, key, text).withColumn("_row", F.monotonically_increasing_id()))
    keyed = narrow.where(F.col("_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["_one", "_two", "n_shingles"]
    classes = cut_lineage(keyed.groupBy(*same).agg(F.min("_row").alias("_node"), F.count("*").alias("_copies")))
    firsts = keyed.join(classes.select(F.col("_node").alias("_row")), "_row", "left_semi").withColumnRenamed("_row", "_node")
    spread = firsts.select("_node", F.explode("_bands").alias("_key"))
    full = spread.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_node").alias("_pivot")).where("_n > 1")
    members = cut_lineage(spread.join(full.select("_key", "_pivot"), "_key"))
    wanted = cut_lineage(firsts.select("_node", "_id", *same).join(members.select("_node").distinct(), "_node"))
    texts = df.select(F.col(key).cast("long").alias("_id"), text).join(wanted.select("_id"), "_id", "left_semi")
    sets = _sets(texts, text).join(wanted, ["_id", *same]).select("_node", "_sign", "_set")
    sets = cut_lineage(sets.dropDuplicates(["_node"]))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = cut_lineage(members.where("_node != _pivot").select(*ordered("_node", "_pivot")).distinct())
    links = _verified(first, sets, threshold)
    mixed = _mixed(members.select("_key", "_node"), components(links))

    turn = F.xxhash64("_node", F.pmod("_key", F.lit(8)))
    pivots = mixed.where("_n > 2").groupBy("_key").agg(F.min_by(F.struct("_node", "_root"), turn).alias("_p"))
    second = mixed.join(pivots, "_key").where("_root != _p._root").select(*ordered("_node", "_p._node")).distinct()
    second = cut_lineage(second.join(first, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(second, sets, threshold))
    mixed = _mixed(members.select("_key", "_node"), components(links))

    few = mixed.where(f"_n > 2 and _n <= {small}")
    other = few.select("_key", F.col("_node").alias("_o"), F.col("_root").alias("_r"))
    third = few.join(other, "_key").where("_node < _o and _root != _r").select(F.col("_node").alias("a"), F.col("_o").alias("b"))
    third = third.distinct().join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(cut_lineage(third), sets, threshold))
    many = mixed.where(f"_n > {max(2, small)}")
    if many.limit(1).count():
        links = links.unionByName(cut_lineage(_in_blocks(many, sets, threshold, block)))

    roots = components(links).withColumnRenamed("node", "_node")
    grouped = classes.join(roots, "_node", "left").where("_copies > 1 or root is not null").select(
        *same, F.coalesce("root", "_node").alias("_root")
    )
    linked = cut_lineage(keyed.select("_row", "_id", *same).join(grouped, same).select("_row", "_id", "_root"))
    smallest = linked.groupBy("_root").agg(F.min("_id").alias("_least"))
    named = linked.join(smallest, "_root").select("_row", "_least")
    component = F.coalesce("_least", "_id")
    return narrow.select("_row", "_id", "n_shingles").join(named, "_row", "left").select(
        F.col("_id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
