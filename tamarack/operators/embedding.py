"""Text features that need no outside model: mean-pooled token vectors and a seeded byte convolution.

Both are ``pyspark.ml`` stages that can be written and read. Token vectors come from a
randomised factorisation of the positive pointwise mutual information of neighbouring tokens.
Counting and the products with the large sparse table run in Spark; what is held whole is the
model itself, ``vocabulary x dims`` numbers, whose size the parameters set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .scratch import kept

TOKEN = r"(?U)\w+|[^\w\s]"
LENGTH = 256


def tokens(text: str | Column, length: int = LENGTH) -> Column:
    """The first ``length`` words and signs of a lower-cased text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), 1, length)


class _Sizes(HasInputCol, HasOutputCol, HasSeed):
    vocabulary = Param(Params._dummy(), "vocabulary", "most tokens with a vector", TypeConverters.toInt)
    dims = Param(Params._dummy(), "dims", "length of a vector", TypeConverters.toInt)
    window = Param(Params._dummy(), "window", "neighbours counted on each side", TypeConverters.toInt)
    length = Param(Params._dummy(), "length", "tokens read of a text", TypeConverters.toInt)


def common_tokens(docs: DataFrame, text: str, most: int, length: int) -> list[str]:
    """The ``most`` tokens that most texts hold; ties by name."""
    each = docs.select(F.explode(F.array_distinct(tokens(text, length))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return [r.token for r in each.orderBy(F.desc("n"), "token").limit(most).collect()]  # as many as the parameter says


def neighbours(docs: DataFrame, text: str, words: list[str], window: int, length: int) -> DataFrame:
    """``i, j, n``: how often words of the list stand within ``window`` tokens of each other, both ways round."""
    place = {w: i for i, w in enumerate(words)}
    size = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for ts in b["t"].to_pylist():
                ids = np.array([place.get(t, -1) for t in ts], np.int64)
                for gap in range(1, min(window, len(ids) - 1) + 1):
                    left, right = ids[:-gap], ids[gap:]
                    known = (left >= 0) & (right >= 0)
                    seen += [left[known] * size + right[known], right[known] * size + left[known]]
            codes, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_pydict({"i": pa.array(codes // max(1, size), pa.int32()), "j": pa.array(codes % max(1, size), pa.int32()), "n": pa.array(n, pa.int64())})

    return docs.select(tokens(text, length).alias("t")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def information(pairs: DataFrame) -> DataFrame:
    """``i, j, v``: the positive pointwise mutual information of counted pairs, all of a row in one partition."""
    own = pairs.groupBy("i").agg(F.sum("n").alias("own"))  # a row for each word
    total = pairs.agg(F.sum("n").alias("total"))  # one row
    v = F.log(F.col("n") * F.col("total") / (F.col("own") * F.col("other")))
    joined = pairs.join(own, "i").join(own.select(F.col("i").alias("j"), F.col("own").alias("other")), "j").join(F.broadcast(total))
    return joined.select("i", "j", v.alias("v")).where("v > 0").repartition("i")


def product(matrix: DataFrame, x: np.ndarray) -> np.ndarray:
    """``matrix @ x``; rows of the matrix lie in one partition each, so that each row of the result is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            i, j, v = (b[c].to_numpy(zero_copy_only=False) for c in ("i", "j", "v"))
            rows, where = np.unique(i, return_inverse=True)
            sums = np.zeros((len(rows), x.shape[1]))
            np.add.at(sums, where, v[:, None] * x[j])
            for r, s in zip(rows.tolist(), sums, strict=True):
                out[r] = out[r] + s if r in out else s
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(out), pa.int32()), "row": pa.array([s.tolist() for s in out.values()], pa.list_(pa.float64()))})

    got = matrix.mapInArrow(run, "i int, row array<double>").collect()
    out = np.zeros((len(x), x.shape[1]))
    for r in got:
        out[r.i] += r.row  # a row read in two pieces comes twice
    return out


def factorised(matrix: DataFrame, size: int, dims: int, seed: int, rounds: int = 2, spare: int = 8) -> np.ndarray:
    """Vectors of the ``size`` rows of a symmetric table: its leading eigenvectors, each times the root of its value's size."""
    width = min(size, dims + spare)
    x = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(rounds + 1):
        x = np.linalg.qr(product(matrix, x))[0]
    small = x.T @ product(matrix, x)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:dims]
    vectors = x @ turn[:, first] * np.sqrt(np.abs(values[first]))
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


class TokenVectors(Estimator, _Sizes, DefaultParamsReadable, DefaultParamsWritable):
    """Fits token vectors on all texts of a table; texts may be null or empty."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "embedding", vocabulary: int = 5000, dims: int = 128, window: int = 4, length: int = LENGTH, seed: int = 1337) -> None:  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="embedding", vocabulary=5000, dims=128, window=4, length=LENGTH, seed=1337)

    def _fit(self, dataset: DataFrame) -> MeanEmbedding:
        p = {k: self.getOrDefault(k) for k in ("inputCol", "outputCol", "dims", "window", "length", "seed")}
        words = common_tokens(dataset, p["inputCol"], self.getOrDefault("vocabulary"), p["length"])
        if not words:
            return self._copyValues(MeanEmbedding([], np.zeros((0, p["dims"]))))
        pairs = kept(neighbours(dataset, p["inputCol"], words, p["window"], p["length"]), "pairs")
        vectors = factorised(kept(information(pairs), "information"), len(words), p["dims"], p["seed"])
        return self._copyValues(MeanEmbedding(words, vectors))


def pooled(words: list[str], vectors: np.ndarray, ts: pd.Series) -> np.ndarray:
    """Mean vectors of the known tokens of each text at unit length; zeros where none is known or they cancel out."""
    place = {w: i for i, w in enumerate(words)}
    out = np.zeros((len(ts), vectors.shape[1]))
    for k, t in enumerate(ts):
        ids = [i for w in t if (i := place.get(w)) is not None]
        if ids:
            mean = vectors[ids].mean(0)
            norm = np.linalg.norm(mean)
            out[k] = mean / norm if norm > 1e-9 else 0
    return out


class MeanEmbedding(Model, _Sizes, MLReadable, MLWritable):
    """Adds the mean-pooled embedding of a text as a vector column."""

    def __init__(self, words: list[str] | None = None, vectors: np.ndarray | None = None) -> None:
        super().__init__()
        self.words, self.vectors = words or [], vectors
        self._setDefault(inputCol="text", outputCol="embedding", vocabulary=5000, dims=128, window=4, length=LENGTH, seed=1337)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words, vectors = self.words, self.vectors

        @F.pandas_udf(ArrayType(DoubleType()))
        def embed(ts: pd.Series) -> pd.Series:
            return pd.Series(list(pooled(words, vectors, ts)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(embed(tokens(self.getInputCol(), self.getOrDefault("length")))))

    def write(self) -> MLWriter:
        return _VectorsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _VectorsReader(cls)


class _VectorsWriter(MLWriter):
    def __init__(self, model: MeanEmbedding) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(i, w, v) for i, (w, v) in enumerate(zip(self.model.words, self.model.vectors.tolist(), strict=True))]
        self.sparkSession.createDataFrame(rows, "place int, word string, vector array<double>").write.parquet(f"{path}/data")


class _VectorsReader(MLReader):
    def __init__(self, cls: type[MeanEmbedding]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> MeanEmbedding:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("place").collect()
        model = self.cls([r.word for r in rows])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.vectors = np.array([r.vector for r in rows]) if rows else np.zeros((0, model.getOrDefault("dims")))
        model._resetUid(metadata["uid"])
        return model


class ByteConvolution(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Features of a text's first bytes by a convolution with fixed random filters.

    Bytes have 32-number embeddings, 64 filters of width 5 run over them (zeros beyond both
    ends), and the largest value of each, at least 0, goes through a linear map. Texts are cut or
    filled with zero bytes to ``length``; null is an empty text. Nothing is fitted: the seed
    gives all weights.
    """

    length = Param(Params._dummy(), "length", "bytes read of a text", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "length of the result", TypeConverters.toInt)
    EMBEDDING, FILTERS, WIDTH = 32, 64, 5

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "bytes", length: int = 256, size: int = 128, seed: int = 1337) -> None:  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="bytes", length=256, size=128, seed=1337)

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embedding, filters (width x embedding x filters), their offsets, the linear map and its offsets."""
        rng = np.random.default_rng(self.getSeed())
        near = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
        fan = self.EMBEDDING * self.WIDTH
        return rng.standard_normal((256, self.EMBEDDING)), near(fan, self.WIDTH, self.EMBEDDING, self.FILTERS), near(fan, self.FILTERS), near(self.FILTERS, self.FILTERS, self.getOrDefault("size")), near(self.FILTERS, self.getOrDefault("size"))

    def features(self, texts: list[str | None]) -> np.ndarray:
        length = self.getOrDefault("length")
        embedding, filters, offsets, linear, shift = self.weights()
        ids = np.zeros((len(texts), length), np.uint8)
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "ignore")[:length]
            ids[k, : len(raw)] = np.frombuffer(raw, np.uint8)
        total = np.tile(offsets, (len(texts), length, 1))
        half = self.WIDTH // 2
        for k in range(self.WIDTH):  # what byte b gives the filters at place k of their width is a row of a table
            table, gap = embedding @ filters[k], k - half
            low, high = max(0, -gap), min(length, length - gap)
            total[:, low:high] += table[ids[:, low + gap : high + gap]]
        return np.maximum(total.max(1), 0) @ linear + shift

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = ByteConvolution(**{k: self.getOrDefault(k) for k in ("inputCol", "outputCol", "length", "size", "seed")}).features

        @F.pandas_udf(ArrayType(DoubleType()))
        def convolve(texts: pd.Series) -> pd.Series:
            return pd.Series([f for at in range(0, len(texts), 256) for f in features(texts.iloc[at : at + 256].tolist())])

        return dataset.withColumn(self.getOutputCol(), array_to_vector(convolve(F.col(self.getInputCol()))))
