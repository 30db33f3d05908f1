"""Feature transformers, scalers and the SVD projection as stages of a Spark ML pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import ElementwiseProduct, Normalizer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from tellsift.functions import features as X
from tellsift.functions.text import let
from tellsift.functions.tokens import annotate
from tellsift.operators import svd, vectorize
from tellsift.operators.common import computed, computed_struct
from tellsift.operators.frequency import token_grams
from tellsift.operators.quantiles import exact_quantiles
from tellsift.operators.selection import entries, mutual_information
from tellsift.session import cut_lineage, written


#: Up to this many columns an SVD adds up the columns' products, 128 MB at most.
GRAM_COLUMNS = 4096
#: Numbers of an SVD's basis that are broadcast: 64 MB.
BROADCAST_CELLS = 2**23
#: Terms, or columns with a weight, that are broadcast with 8 bytes each: 64 MB.
BROADCAST_TERMS = 2**23
#: As many terms as a vector can have.
ALL_TERMS = 2**31 - 1


def max_share(share: float, rows: int | None = None, least: float = 1.0) -> float:
    """``maxDF`` for a share of the rows; the counter would take 1.0 for a single row.

    With the number of ``rows`` it is a number of rows, since the counter keeps all rows' terms to count the rows by itself.
    Below 1 row, or below ``least`` (its ``minDF``), the counter takes a share only.
    """
    if share >= 1.0:
        return float(2**62)
    return share if rows is None or share * rows < max(least, 1.0) else share * rows


class _FeatureStage(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns of one feature group, worked out from ``inputCol``."""

    names: list[str] = []

    @keyword_only
    def __init__(self, *, inputCol="sents"):
        super().__init__()
        self._setDefault(inputCol="sents")
        self._set(**self._input_kwargs)

    def features(self, column):
        raise NotImplementedError

    def get_feature_names(self) -> list[str]:
        return list(self.names)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = dataset.drop(*self.names)
        return computed_struct(kept, self.features(F.col(self.getInputCol())))


class LengthFeatures(_FeatureStage):
    names = X.LENGTH_COLUMNS

    def features(self, column):
        return X.length_features(column)


class PosFeatures(_FeatureStage):
    names = X.POS_COLUMNS

    def features(self, column):
        return let(annotate(column), X.pos_features)


class SentimentFeatures(_FeatureStage):
    names = X.SENTIMENT_COLUMNS

    def features(self, column):
        return X.sentence_sentiment(column)


class TokenGrams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Token string to an array of n-grams: lower case or not, without stop words."""

    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)
    lower = Param(Params._dummy(), "lower", "lower-case first", TypeConverters.toBoolean)
    stop = Param(Params._dummy(), "stop", "words to leave out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="tokens", outputCol="grams", low=1, high=1, lower=True, stop=[]):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="grams", low=1, high=1, lower=True, stop=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        grams = token_grams(
            F.col(self.getInputCol()),
            self.getOrDefault("low"),
            self.getOrDefault("high"),
            self.getOrDefault("lower"),
            self.getOrDefault("stop"),
        )
        return computed(dataset, **{self.getOutputCol(): grams})


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to ``1 + ln(count)``, on Arrow batches, vectors staying sparse."""

    @keyword_only
    def __init__(self, *, inputCol="counts", outputCol="logtf"):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="logtf")
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        @F.pandas_udf(VectorUDT())
        def log_counts(batch: pd.DataFrame) -> pd.DataFrame:
            return batch.assign(values=[1.0 + np.log(v) for v in batch["values"]])

        return dataset.withColumn(self.getOutputCol(), log_counts(self.getInputCol()))


class _TableModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A model whose numbers are a written table of a row per column; they come to the driver only to be sent on, if few."""

    size = Param(Params._dummy(), "size", "number of columns", TypeConverters.toInt)

    def __init__(self, table=None):
        super().__init__()
        self.table = table
        self._shared = None

    def _few(self) -> bool:
        return self.getOrDefault("size") <= BROADCAST_TERMS

    def _sent(self, spark, numbers):
        """The numbers, sent to the workers once for each model."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(numbers())
        return self._shared

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/table"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _vectors(lengths: np.ndarray, columns: np.ndarray, values: np.ndarray, widths: np.ndarray) -> pa.StructArray:
    """Sparse vectors from their rows' numbers of cells and the cells of all rows; a NaN stays one."""
    ends = pa.array(np.r_[0, np.cumsum(lengths)], "int32")
    held = [pa.ListArray.from_arrays(ends, pa.array(columns, "int32")), pa.ListArray.from_arrays(ends, pa.array(values, "float64"))]
    kinds = pa.array(np.zeros(len(lengths)), "int8")
    return pa.StructArray.from_arrays([kinds, pa.array(widths, "int32"), *held], ["type", "size", "indices", "values"])


def _cells_of(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_vectors`` takes, of any vectors; a dense one stores no columns, they are the places. A null one has no cells."""
    kind, size, at, values = vectors.flatten()
    lengths = pc.list_value_length(values).fill_null(0).to_numpy()
    dense = kind.fill_null(0).to_numpy() == 1
    flat = values.flatten().to_numpy(zero_copy_only=False)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns[~np.repeat(dense, lengths)] = at.flatten().to_numpy(zero_copy_only=False)
    return lengths, columns, flat, np.where(dense, lengths, size.fill_null(0).to_numpy())


@F.arrow_udf(VectorUDT())
def _sparse(columns: pa.Array, values: pa.Array, sizes: pa.Array) -> pa.Array:
    """Vectors from sorted arrays of columns and their values."""
    lengths = pc.list_value_length(columns).to_numpy()
    return _vectors(lengths, columns.flatten().to_numpy(), values.flatten().to_numpy(), sizes.to_numpy())


def _with_vectors(rows: DataFrame, cells: DataFrame, size: int, out: str) -> DataFrame:
    """``rows`` with the vectors that the cells ``(_row, col, value)`` make up, without ``_row``."""
    held = cells.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_held"))
    empty = F.array().cast("array<struct<col:int,value:double>>")
    whole = rows.join(held, "_row", "left").withColumn("_held", F.coalesce("_held", empty))
    return whole.withColumn(out, _sparse("_held.col", "_held.value", F.lit(size))).drop("_row", "_held")


class TermCounter(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Arrays of terms to sparse vectors of their counts; the vocabulary is a table, of which no string comes to the driver.

    A term is kept that stands in at least ``minDF`` and at most ``maxDF`` rows (shares of the rows below 1), with a ``vocabSize``
    only the most frequent, ties by term. Columns are numbered in the order of the terms' hashes.
    """

    minDF = Param(Params._dummy(), "minDF", "fewest rows of a term", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "most rows of a term", TypeConverters.toFloat)
    vocabSize = Param(Params._dummy(), "vocabSize", "most terms", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="grams", outputCol="counts", minDF=1.0, maxDF=float(2**62), vocabSize=ALL_TERMS):
        super().__init__()
        self._setDefault(inputCol="grams", outputCol="counts", minDF=1.0, maxDF=float(2**62), vocabSize=ALL_TERMS)
        self._set(**self._input_kwargs)

    def getMaxDF(self) -> float:
        return self.getOrDefault("maxDF")

    def _fit(self, dataset):
        grams, most = F.col(self.getInputCol()), self.getOrDefault("vocabSize")
        bounds = [self.getOrDefault("minDF"), self.getOrDefault("maxDF")]
        if min(bounds) < 1.0:
            n = dataset.count()
            bounds = [b if b >= 1.0 else b * n for b in bounds]
        if most < ALL_TERMS:
            rows = dataset.select(grams.alias("_grams")).withColumn("_row", F.monotonically_increasing_id())
            counts = vectorize.term_counts(rows, "_row", F.col("_grams"))
        else:
            # how often a term stands in a row is asked only for the most frequent ones
            counts = dataset.select(F.explode(F.array_distinct(grams)).alias("term"), F.lit(1).alias("tf"))
        terms = counts.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        terms = terms.where(F.col("df").between(*bounds))
        if most < ALL_TERMS:
            terms = terms.orderBy(F.desc("total"), "term").limit(most)
        terms, seed = written(terms.select("term", "df")), 0
        size = terms.count()
        if not size:
            raise ValueError("no term is in enough rows and not in too many: the vocabulary is empty")
        while terms.select(_hash(F.col("term"), seed)).distinct().count() < size:
            seed += 1  # two terms of equal hash
        model = TermCounterModel(vectorize.numbered(terms.select("*", _hash(F.col("term"), seed).alias("hash")), "hash"))
        return self._copyValues(model._set(size=size, seed=seed))


def _hash(term, seed: int):
    return F.xxhash64(term, F.lit(seed))


class TermCounterModel(_TableModel):
    """The vocabulary is a table ``(term, df, hash, id)``.

    The hashes of up to ``BROADCAST_TERMS`` terms are sent to the workers, and no term is shuffled; a word outside the vocabulary
    is taken for one of its n terms with a chance of n / 2**64. Beyond, terms are joined; the rows are written before.
    """

    seed = Param(Params._dummy(), "seed", "seed of the hashes", TypeConverters.toInt)
    minDF, maxDF, vocabSize = TermCounter.minDF, TermCounter.maxDF, TermCounter.vocabSize

    @property
    def vocabulary(self) -> list[str]:
        """The terms by column, for a small vocabulary."""
        return [r["term"] for r in self.table.select("term", "id").orderBy("id").collect()]

    def _transform(self, dataset):
        out, size = self.getOutputCol(), self.getOrDefault("size")
        grams = F.coalesce(F.col(self.getInputCol()), F.array().cast("array<string>"))
        dataset = dataset.drop(out)
        if not self._few():
            rows = cut_lineage(dataset.withColumn("_row", F.monotonically_increasing_id()))
            counts = rows.select("_row", F.explode(grams).alias("term")).groupBy("_row", "term").agg(F.count("*").cast("double").alias("value"))
            cells = counts.join(self.table.select("term", F.col("id").cast("int").alias("col")), "term").drop("term")
            return _with_vectors(rows, cells, size, out)
        shared = self._sent(dataset.sparkSession, lambda: np.sort(self.table.select("hash").toArrow()["hash"].to_numpy()))

        @F.arrow_udf(VectorUDT())
        def count(hashes: pa.Array) -> pa.Array:
            known, rows = shared.value, len(hashes)
            each = hashes.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, each), len(known) - 1)
            held = known[at] == each
            row = np.repeat(np.arange(rows), pc.list_value_length(hashes).to_numpy())[held]
            cell, n = np.unique(row * len(known) + at[held], return_counts=True)
            return _vectors(np.bincount(cell // len(known), minlength=rows), cell % len(known), n, np.full(rows, len(known)))

        hashed = computed(dataset, _hashes=F.transform(grams, lambda g: _hash(g, self.getOrDefault("seed"))))
        return hashed.withColumn(out, count("_hashes")).drop("_hashes")


def _per_column(dataset: DataFrame, column: str, of_cells, add) -> DataFrame:
    """``(col, x)`` over the columns of vectors: ``of_cells`` makes of values numbers to be merged, ``add`` merges them in Spark."""
    merge, values_of = of_cells

    def work(batches):
        for batch in batches:
            _, place, flat, _ = _cells_of(pa.StructArray.from_arrays(batch.columns, batch.schema.names))
            order = np.argsort(place, kind="stable")
            place, flat = place[order], values_of(flat[order])
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, "int64")
            found = merge.reduceat(flat, first) if len(place) else flat
            yield pa.RecordBatch.from_arrays([pa.array(place[first], "int32"), pa.array(found, "float64")], ["col", "x"])

    vectors = computed(dataset.select(column).where(F.col(column).isNotNull()), _v=F.unwrap_udt(F.col(column)))
    return vectors.select("_v.type", "_v.size", "_v.indices", "_v.values").mapInArrow(work, "col int, x double").groupBy("col").agg(add("x").alias("x"))


#: In how many rows a column is above zero; a column's greatest magnitude, NaN left out.
_ABOVE_ZERO = (np.add, lambda v: (v > 0).astype("float64")), F.sum
_GREATEST = (np.fmax, lambda v: np.nan_to_num(np.abs(v), nan=0.0, posinf=np.inf)), F.max


class ColumnWeights(_TableModel):
    """Multiplies every column by its weight in a table ``(col, w)``, or by ``other`` if it isn't there.

    Up to ``BROADCAST_TERMS`` weights are sent to the workers, more meet the cells by a join, with equal results.
    """

    other = Param(Params._dummy(), "other", "weight of other columns", TypeConverters.toFloat)
    def _numbers(self):
        out = np.full(self.getOrDefault("size"), self.getOrDefault("other"))
        table = self.table.select("col", "w").toArrow()
        out[table["col"].to_numpy()] = table["w"].to_numpy()
        return out

    def _transform(self, dataset):
        column, out, other = self.getInputCol(), self.getOutputCol(), self.getOrDefault("other")
        if not self._few():
            rows = cut_lineage(dataset.withColumn("_row", F.monotonically_increasing_id()))
            cells = _cells(rows, column).join(self.table, "col", "left")
            cells = cells.select(F.col("row").alias("_row"), F.col("col").cast("int").alias("col"), (F.col("value") * F.coalesce("w", F.lit(other))).alias("value"))
            width = rows.select(F.max(F.coalesce(F.unwrap_udt(F.col(column))["size"], F.size(F.unwrap_udt(F.col(column))["values"])))).first()[0]
            return _with_vectors(rows, cells, width or 0, out)
        shared = self._sent(dataset.sparkSession, self._numbers)

        @F.arrow_udf(VectorUDT())
        def weigh(vectors: pa.Array) -> pa.Array:
            w = np.append(shared.value, other)
            lengths, columns, values, widths = _cells_of(vectors)
            return _vectors(lengths, columns, values * w[np.minimum(columns, len(w) - 1)], widths)

        return dataset.withColumn(out, F.when(F.col(column).isNotNull(), weigh(column)))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weights ``ln((1 + n) / (1 + df)) + 1``; fits to a product of the columns and a table of weights."""

    @keyword_only
    def __init__(self, *, inputCol="counts", outputCol="weighted"):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="weighted")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        rows = dataset.where(F.col(self.getInputCol()).isNotNull()).count()
        found = written(_per_column(dataset, self.getInputCol(), *_ABOVE_ZERO))
        weights = found.select("col", (F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("x"))) + 1).alias("w"))
        model = ColumnWeights(weights)._set(size=_width(found), other=float(np.log(1.0 + rows) + 1))
        return self._copyValues(model)


def _width(found: DataFrame) -> int:
    """One more than the last column of a table."""
    last = found.agg(F.max("col")).first()[0]
    return 0 if last is None else last + 1


class MaxAbs(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Divides every column by its greatest magnitude; a column of zeros is left."""

    @keyword_only
    def __init__(self, *, inputCol="assembled", outputCol="scaled"):
        super().__init__()
        self._setDefault(inputCol="assembled", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        found = written(_per_column(dataset, self.getInputCol(), *_GREATEST))
        weights = found.where("x > 0").select("col", (F.lit(1.0) / F.col("x")).alias("w"))
        return self._copyValues(ColumnWeights(weights)._set(size=_width(found), other=1.0))


class Assembler(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector followed by columns of numbers, nulls as NaN.

    Spark's assembler holds a named attribute for each column of the vectors, on the driver and in each plan.
    """

    columns = Param(Params._dummy(), "columns", "columns behind the vector", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="tfidf", outputCol="assembled", columns=[]):
        super().__init__()
        self._setDefault(inputCol="tfidf", outputCol="assembled", columns=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        m = len(self.getOrDefault("columns"))

        @F.arrow_udf(VectorUDT())
        def joined(vectors: pa.Array, numbers: pa.Array) -> pa.Array:
            lengths, columns, values, widths = _cells_of(vectors)
            row = np.arange(len(lengths))
            # a row's cells move up by the numbers of the rows before, which stand behind these rows' cells
            moved = np.arange(len(values)) + np.repeat(m * row, lengths)
            behind = (np.cumsum(lengths) + m * row)[:, None] + np.arange(m)
            at, v = np.empty(len(values) + m * len(row), "int64"), np.empty(len(values) + m * len(row))
            at[moved], v[moved] = columns, values
            at[behind], v[behind] = widths[:, None] + np.arange(m), numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            return _vectors(lengths + m, at, v, widths + m)

        if not m:
            return dataset.withColumn(self.getOutputCol(), F.col(self.getInputCol()))
        numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.getOrDefault("columns")])
        column = self.getInputCol()
        return dataset.withColumn(self.getOutputCol(), F.when(F.col(column).isNotNull(), joined(column, numbers)))


def quartile_ranges(dataset: DataFrame, column: str) -> np.ndarray:
    """The distance between the quartiles of each column of the vectors; zeros that sparse vectors leave out count.

    The vectors are written first, since each round of the quantiles reads them again and would work them out anew from the text.
    """
    dataset = written(dataset.select(column).where(F.col(column).isNotNull()))
    n, width = dataset.select(F.count(column), F.max(F.unwrap_udt(F.col(column))["size"])).first()
    first = dataset.first()
    out = np.zeros(width or (len(first[0]) if first else 0))
    values = entries(dataset, column).withColumn("n", F.lit(1).cast("long"))
    zeros = values.groupBy("feature").agg(F.lit(0.0).alias("value"), (F.lit(n) - F.count("*")).alias("n"))
    found = exact_quantiles(values.unionByName(zeros), ["feature"], "value", [0.25, 0.75], weight="n")
    for row in found.groupBy("feature").agg((F.max("quantile") - F.min("quantile")).alias("spread")).toLocalIterator():
        out[row["feature"]] = row["spread"]
    return out


class MutualInformationSelector(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the ``k`` columns that tell most about the label, by mutual information; ties by column number."""

    k = Param(Params._dummy(), "k", "columns kept", TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="assembled", outputCol="features", labelCol="label", k=100):
        super().__init__()
        self._setDefault(inputCol="assembled", outputCol="features", labelCol="label", k=100)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column = self.getInputCol()
        rows = dataset.select(column, F.col(self.getOrDefault("labelCol")).alias("label")).where(F.col("label").isNotNull() & F.col(column).isNotNull())
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        best = mutual_information(entries(rows, column, "label"), sizes).orderBy(F.desc("mi"), "feature").limit(self.getOrDefault("k"))
        return VectorSlicer(inputCol=column, outputCol=self.getOutputCol(), indices=sorted(r["feature"] for r in best.collect()))


class ColumnScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Divides every column by its spread, without centring; a spread of 0 leaves the column.

    ``spread`` is ``std`` (deviation with denominator n) or ``iqr`` (exact quartile range, zeros included).
    """

    spread = Param(Params._dummy(), "spread", "std or iqr", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="assembled", outputCol="scaled", spread="std"):
        super().__init__()
        self._setDefault(inputCol="assembled", outputCol="scaled", spread="std")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column = self.getInputCol()
        if self.getOrDefault("spread") == "std":
            stats = dataset.select(
                Summarizer.metrics("variance", "count").summary(F.col(column)).alias("s")
            ).select("s.variance", "s.count").first()
            n = max(stats["count"], 1)
            spread = np.sqrt(stats["variance"].toArray() * (n - 1) / n)
        else:
            spread = quartile_ranges(dataset, column)
        scale = np.divide(1.0, spread, out=np.ones_like(spread), where=spread > 0)
        return ElementwiseProduct(
            scalingVec=DenseVector(scale), inputCol=column, outputCol=self.getOutputCol()
        )


class TruncatedSvd(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Projection on the ``k`` leading right singular vectors.

    Up to ``GRAM_COLUMNS`` columns they are read off the columns' products, exactly and in one pass; beyond, found by rounds
    over a table of cells, and no matrix of all columns meets in one place.
    """

    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="scaled", outputCol="features", k=100):
        super().__init__()
        self._setDefault(inputCol="scaled", outputCol="features", k=100)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column, k = self.getInputCol(), self.getOrDefault("k")
        rows = MLUtils.convertVectorColumnsFromML(dataset.select(column).where(F.col(column).isNotNull()), column).persist()
        first = rows.first()
        if first is not None and first[0].size <= GRAM_COLUMNS:
            model = self._narrow(dataset, RowMatrix(rows), k)
        else:
            found = svd.leading(_cells(dataset.withColumn("_row", F.monotonically_increasing_id()), column), k)
            model = TruncatedSvdModel(found.basis, len(found.values))
        rows.unpersist()
        model._setDefault(inputCol="scaled", outputCol="features", k=100)
        return self._copyValues(model)

    def _narrow(self, dataset, matrix, k):
        """The eigenvectors of the columns x columns products, which one pass adds up."""
        values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
        components = vectors[:, np.argsort(values)[::-1][:k]]
        largest = np.abs(components).argmax(axis=0)
        components = components * np.sign(components[largest, np.arange(components.shape[1])])
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(components)]
        return TruncatedSvdModel(dataset.sparkSession.createDataFrame(rows, "col int, v array<double>"), components.shape[1])


def _cells(dataset: DataFrame, column: str) -> DataFrame:
    return entries(dataset.where(F.col(column).isNotNull()), column, "_row").select(F.col("_row").alias("row"), F.col("feature").alias("col"), "value")


class TruncatedSvdModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """The basis is a table ``(col, v)`` with ``size`` weights per column.

    A basis of up to ``BROADCAST_CELLS`` numbers is sent to the workers, a larger one is met by a join, with equal results.
    A column that had only zeros adds nothing; a null vector stays null.
    """

    k = TruncatedSvd.k

    def __init__(self, basis=None, size=0):
        super().__init__()
        self.basis, self.size = basis, size
        self._columns = None

    def columns(self) -> int:
        """One more than the last column that the basis holds."""
        if self._columns is None:
            last = self.basis.agg(F.max("col")).first()[0]
            self._columns = 0 if last is None else last + 1
        return self._columns

    @property
    def components(self) -> np.ndarray:
        """The components x columns matrix, for a small basis."""
        out = np.zeros((self.columns(), self.size))
        for row in self.basis.toLocalIterator():
            out[row["col"]] = row["v"]
        return out.T

    def _transform(self, dataset):
        if self.columns() * self.size > BROADCAST_CELLS:
            return self._joined(dataset)
        shared = dataset.sparkSession.sparkContext.broadcast(np.ascontiguousarray(self.components.T))

        @F.pandas_udf(VectorUDT())
        def project(batch: pd.DataFrame) -> pd.DataFrame:
            basis = shared.value
            dense = []
            for indices, values in zip(batch["indices"], batch["values"]):
                if values is None:
                    dense.append(None)
                    continue
                at = np.arange(len(values)) if indices is None else np.asarray(indices, "int64")
                known = at < len(basis)
                dense.append(np.asarray(values)[known] @ basis[at[known]])
            none = [None] * len(dense)
            return pd.DataFrame(
                {"type": np.ones(len(dense), "int8"), "size": pd.array(none, "Int32"), "indices": none, "values": dense}
            )

        column = self.getInputCol()
        return dataset.withColumn(self.getOutputCol(), F.when(F.col(column).isNotNull(), project(column)))

    def _joined(self, dataset):
        """The same by a join of cells and basis; the rows are written first, so that their numbers stay."""
        column = self.getInputCol()
        rows = cut_lineage(dataset.withColumn("_row", F.monotonically_increasing_id()))
        found = svd.project(_cells(rows, column), self.basis, self.size).select(F.col("row").alias("_row"), F.col("v").alias("_v"))
        value = F.coalesce("_v", F.array_repeat(F.lit(0.0), self.size))
        return rows.join(found, "_row", "left").withColumn(
            self.getOutputCol(), F.when(F.col(column).isNotNull(), array_to_vector(value))
        ).drop("_row", "_v")

    def write(self):
        return _SvdWriter(self)

    @classmethod
    def read(cls):
        return _SvdReader()


class _SvdWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance.basis.withColumn("size", F.lit(self.instance.size)).write.parquet(f"{path}/basis")


class _SvdReader(MLReader):
    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path}/basis")
        size = table.agg(F.max("size")).first()[0] or 0
        model = TruncatedSvdModel(table.select("col", "v"), size)
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


SCALERS = {
    "maxabs": lambda i, o: MaxAbs(inputCol=i, outputCol=o),
    "std": lambda i, o: ColumnScaler(inputCol=i, outputCol=o, spread="std"),
    "robust": lambda i, o: ColumnScaler(inputCol=i, outputCol=o, spread="iqr"),
    "l2": lambda i, o: Normalizer(inputCol=i, outputCol=o, p=2.0),
}

__all__ = [
    "Assembler", "ColumnScaler", "ColumnWeights", "LengthFeatures", "MaxAbs", "MutualInformationSelector", "PosFeatures", "SCALERS",
    "SentimentFeatures", "SmoothIdf", "SublinearTf", "TermCounter", "TermCounterModel", "TokenGrams", "TruncatedSvd", "TruncatedSvdModel",
    "array_to_vector", "vector_to_array",
]
