"""Exact top-k by inner product with block-at-a-time pruning.

Components are taken as term weights of two signs, so a block's term maxima are its largest and its
smallest value per component, and the sum over a query's components of the larger product bounds every
score in the block. Vectors are put in order of their nearest anchor, so that a block's vectors are
alike and its bounds tight, and cut into segments of some blocks. Each query visits its own segment
first; the k-th score found there is the threshold it takes along to all other segments. In a segment a
query takes blocks by falling bound, scores them through their forward index, the matrix of their
vectors, and stops where the bound is below its k-th score. Equal bounds are still looked at, since
ties go to smaller ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tellsift.llm.common import cut_lineage

SCALE = 256
ANCHORS = 256
BLOCK = 64
SEGMENT = 4096
QUERY_BATCH = 4096
#: Sums of products under this many bits are exact in doubles.
_EXACT = float(1 << 53)
#: Sums of products under this many bits are exact in 64-bit integers, and so is the sum of two.
_WIDE = float(1 << 62)
#: Under every score.
_NONE = -(1 << 140)


def quantised(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(_id, _dim, _v): floor(scale * x) of each component. Rows with a null key, a null vector or a component
    that is null or not finite take no part. A scaled component or a score outside of 64 bits stops the query, as in SQL."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    limit = float(1 << 63)
    level = lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a scaled component passes 64 bits")).cast("long"))
    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    return df.where(fit).select(
        F.col(key).cast("long").alias("_id"), F.size(vector).alias("_dim"),
        F.transform(wide, level).alias("_v"),
    )


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(column), 0), np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where they are exact there, in Python integers where 64 bits may not do."""
    if left.shape[1] == 0 or not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if most < _EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T if most < _WIDE else left.astype(object) @ right.T.astype(object)


def _segments(vectors: DataFrame, anchors: int, segment: int) -> DataFrame:
    """Add _seg (within _dim) and _near, the nearest anchor; anchors are the vectors of smallest hash."""
    picked = vectors.withColumn("_h", F.xxhash64("_id", "_v"))
    sample = picked.groupBy("_dim", F.pmod("_h", F.lit(anchors)).alias("_slot")).agg(F.min_by("_v", "_h").alias("_v"))
    picks: dict[int, list] = {}  # at most ``anchors`` vectors for each length
    for row in sample.orderBy("_dim", "_slot").collect():
        picks.setdefault(row["_dim"], []).append(row["_v"])
    held = {dim: np.array(rows, dtype=np.float64).reshape(len(rows), dim) for dim, rows in picks.items()}

    def near(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            out = np.zeros(len(dims), dtype=np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                points = _matrix(batch.column(2).take(pa.array(rows)), int(dim)).astype(np.float64)
                places = held[int(dim)]
                if dim:
                    out[rows] = (points @ places.T - (places**2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["_id", "_dim", "_v", "_near"])

    placed = cut_lineage(vectors.mapInArrow(near, "_id long, _dim int, _v array<long>, _near int"))
    sizes = placed.groupBy("_dim", "_near").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_dim").orderBy("_near")
    sizes = sizes.select(
        "_dim", "_near", "_n", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from")
    )
    # at most ANCHORS rows per dimension; a large anchor's vectors are spread by hash over its stretch
    spot = F.col("_from") + F.floor((F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)) * F.col("_n"))
    return placed.join(F.broadcast(sizes), ["_dim", "_near"]).select(
        "_id", "_dim", "_v", "_near", F.floor(spot / segment).cast("int").alias("_seg")
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def _search(queries: pa.Table, rows: pa.Table, dim: int, k: int, block: int) -> pa.Table:
    """Best k of ``rows`` for each query, not below its threshold."""
    order = np.lexsort((rows["_id"].to_numpy(), rows["_near"].to_numpy()))
    ids, vectors = rows["_id"].to_numpy()[order], _matrix(rows["_v"], dim)[order]
    starts = np.arange(0, len(ids), block)
    high, low = (op.reduceat(vectors, starts, axis=0) if len(ids) else vectors for op in (np.maximum, np.minimum))
    asked, floor_ = _matrix(queries["_v"], dim), queries["_floor"].to_pylist()
    numbers, names = queries["_row"].to_numpy(), queries["_id"].to_numpy()
    out = ([], [], [])
    bounds = products(np.maximum(asked, 0), high) + products(np.minimum(asked, 0), low)
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    for q in range(len(asked)):
        least = _NONE if floor_[q] is None else floor_[q]
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(starts) and bounds[q, ranked[q, at]] >= least:
            some = [b for b in ranked[q, at : at + 8] if bounds[q, b] >= least]
            at += 8
            places = (starts[some][:, None] + np.arange(block)).ravel()
            places = places[places < len(ids)]
            places = places[ids[places] != names[q]]
            score = products(asked[q : q + 1], vectors[places])[0]
            good = score >= least
            best_s, best_i = np.concatenate([best_s, score[good]]), np.concatenate([best_i, ids[places[good]]])
            if len(best_s) > k:
                top = _best(best_s, best_i, k)
                best_s, best_i = best_s[top], best_i[top]
            if len(best_s) == k:
                least = max(least, int(best_s.min()))
        out[0].append(np.full(len(best_s), numbers[q]))
        out[1].append(best_i)
        out[2].append(best_s)
    parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({"_row": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].tolist(), pa.int64())})


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, block: int = BLOCK, segment: int = SEGMENT, query_batch: int = QUERY_BATCH,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` best rows of ``df``, all if fewer.

    Rows with the query's own id are no candidates; rows that repeat another id are candidates each, and
    repeated query rows are answered once per distinct vector. Ties go to the smaller id. Vectors meet
    vectors of their own length only; for what takes no part see ``quantised``. Empty tables: no rows.
    """
    schema = "_row long, vec_id long, score long"
    placed = cut_lineage(_segments(cut_lineage(quantised(df, key, vector, scale)), ANCHORS, segment))
    asked = quantised(queries, key, vector, scale).distinct()
    seg = placed.groupBy("_dim").agg(F.max("_seg").alias("_last"))
    homes = placed.groupBy("_id", "_dim", "_v").agg(F.min("_seg").alias("_home"))
    asked = asked.join(homes, ["_id", "_dim", "_v"], "left").join(F.broadcast(seg), "_dim").withColumn("_home", F.coalesce("_home", F.lit(0)))
    asked = cut_lineage(asked.withColumn("_row", F.monotonically_increasing_id()))
    batches = max(1, -(-asked.count() // query_batch))
    place = F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int")

    def visit(visiting: DataFrame, parts: int) -> DataFrame:
        """Search (_row, _id, _dim, _v, _floor, _seg) in the segments; ``parts``: query batches per segment."""
        left = visiting.withColumn("_batch", place if parts > 1 else F.lit(0))
        right = placed.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            if not one.num_rows or not other.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in ("_row", "vec_id", "score")})
            return _search(one, other, one["_dim"][0].as_py(), k, block)

        keys = ["_dim", "_seg", "_batch"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    columns = ["_row", "_id", "_dim", "_v"]
    own = cut_lineage(visit(asked.select(*columns, F.lit(None).cast("long").alias("_floor"), F.col("_home").alias("_seg")), 1))
    floors = own.groupBy("_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("_floor"))
    away = asked.join(floors, "_row", "left").withColumn("_seg", F.explode(F.sequence(F.lit(0), F.col("_last")))).where("_seg != _home")
    found = own.unionByName(visit(away.select(*columns, "_floor", "_seg"), batches))
    best = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("_row", F.col("_id").alias("query_id")), "_row").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
