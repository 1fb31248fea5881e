"""Text classifiers as ``pyspark.ml`` pipelines and providers for outside scorers."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.sinks import is_done
from . import curves
from .embedding import ByteConvolution, TokenVectors
from .scratch import kept


class Scorer(Protocol):
    """Anything with a column of attack probabilities."""

    def score(self, text: Column) -> Column: ...


def vocabulary(docs: DataFrame, text: str = "text", most: int = 5000) -> DataFrame:
    """The commonest words and pairs of neighbouring words with counts, document counts and smoothed idf.

    A document's terms are sorted, so that the first of each kind is told by its neighbour; one
    aggregate then gives both counts, and only a task's distinct terms are shuffled. A row is a document.
    """
    words = docs.select(F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD + "{2,}"), F.lit(0)).alias("w")).where("size(w) > 0")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    sorted_ = words.select(F.sort_array(F.concat("w", pairs)).alias("t"))
    before = F.concat(F.array(F.lit("")), F.slice("t", F.lit(1), F.size("t") - 1))
    each = sorted_.select(F.inline(F.zip_with("t", before, lambda a, b: F.struct(a.alias("term"), (a != b).cast("long").alias("new")))))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("total"), F.sum("new").alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    idf = F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1
    return counts.join(F.broadcast(n)).select("term", "total", "df", F.round(idf, 6).alias("idf")).orderBy(F.desc("total"), "term").limit(most)


class ShiftedIDF(Estimator):
    """Weights ``log((1 + docs) / (1 + df)) + 1``; fitted, it is a product by constants."""

    def __init__(self, inputCol: str, outputCol: str) -> None:  # noqa: N803  as Spark names them
        super().__init__()
        self.columns = {"inputCol": inputCol, "outputCol": outputCol}

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(**self.columns).fit(dataset).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1), **self.columns)


def _words() -> list:
    return [
        SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_w", gaps=False, pattern=r"(?U)\b\w\w+\b"),
    ]


def worded(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of ``text`` in its place, written once: the passes and folds of a fit read them there."""
    return kept(PipelineModel(_words()).transform(rows).drop("text", "_text"), "words")


def _ngrams(size: int, split: bool = True) -> list:
    """Word uni- and bigrams as counts; idf is shifted by one so that no term vanishes. Rows from ``worded`` need no ``split``."""
    return [
        *(_words() if split else []),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_tf", vocabSize=size),
        ShiftedIDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
    ]


def tfidf_logreg(size: int = 5000, reg: float = 1e-3, split: bool = True) -> Pipeline:
    return Pipeline(stages=[*_ngrams(size, split), LogisticRegression(maxIter=100, regParam=reg, standardization=False)])


def tfidf_svm(size: int = 5000, reg: float = 1e-3, split: bool = True) -> Pipeline:
    return Pipeline(stages=[*_ngrams(size, split), LinearSVC(maxIter=100, regParam=reg, standardization=False)])


def _scaled(columns: list[str], mean: bool = True) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=mean)]


def features_logreg(columns: list[str]) -> Pipeline:
    return Pipeline(stages=[*_scaled(columns), LogisticRegression(maxIter=100, regParam=1e-3)])


def features_mlp(columns: list[str], hidden: tuple[int, ...] = (128, 64), seed: int = 1337) -> Pipeline:
    return Pipeline(stages=[*_scaled(columns), MultilayerPerceptronClassifier(layers=[len(columns), *hidden, 2], seed=seed, maxIter=60)])


def hashed_embedding(size: int = 256) -> Pipeline:
    """An offline stand-in for a sentence encoder: hashed words and bigrams, unit length."""
    return Pipeline(
        stages=[
            SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"),
            RegexTokenizer(inputCol="_text", outputCol="_w", gaps=False, pattern=r"(?U)\w+"),
            NGram(n=2, inputCol="_w", outputCol="_b"),
            SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"),
            HashingTF(inputCol="_t", outputCol="_tf", numFeatures=size),
            Normalizer(inputCol="_tf", outputCol="embedding"),
        ]
    )


def probabilities(model: Model, df: DataFrame) -> DataFrame:
    """Add ``p``: the probability of label 1, or the logistic of a margin."""
    out = model.transform(df)
    if "p" in out.columns and "p" not in df.columns:
        return out
    if "probability" in out.columns:
        return out.withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


_MADE: dict[str, object] = {}


def per_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def asked(call: Callable[[str], str], text: str, tries: int = 3, pause: float = 0.5, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of a service, or an empty one after ``tries`` failures, between which it waits ever twice as long."""
    for k in range(tries):
        try:
            return call(text)
        except Exception:  # noqa: BLE001  an outside service may fail in any way
            if k + 1 < tries:
                sleep(min(longest, pause * 2**k))
    return ""


def judged(df: DataFrame, client: Callable[[], Callable[[str], str]], text: str = "text", tries: int = 3, key: str = "judge", pause: float = 0.5) -> DataFrame:
    """Add ``p`` from an outside judge of the first 4000 characters; failures give 0.5.

    ``client()`` is made once in each worker, under ``key``.
    """
    from ..functions.coerce import judge_probability

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = per_worker(key, client)
        for s in batches:
            yield s.map(lambda t: asked(call, (t or "")[:4000], tries, pause))

    return df.withColumn("p", judge_probability(ask(F.col(text))))


def calibrated(model: Model, held_out: DataFrame, label: str = "label") -> Calibrated:
    """A margin model followed by a logistic map of its margin, fitted on rows that it has not seen."""
    return Calibrated(model, *_margin_map(model.transform(held_out), label))


def _margin_map(scored: DataFrame, label: str) -> tuple[float, float]:
    rows = scored.withColumn("_margin", vector_to_array("rawPrediction")[1]).select(F.col(label).cast("double").alias("label"), "_margin")
    fit = Pipeline(stages=[VectorAssembler(inputCols=["_margin"], outputCol="features"), LogisticRegression(maxIter=50, regParam=1e-6)]).fit(rows).stages[-1]
    return float(fit.coefficients[0]), float(fit.intercept)


def cross_calibrated(build: Pipeline, train: DataFrame, key: str = "row_id", folds: int = 3, label: str = "label") -> Calibrated:
    """Fit on all rows, with a logistic map fitted on margins that models without a row's fold gave it.

    Folds go by a hash of ``key``; a fold of one class, or a rest of one, is left out of the map.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    parts = []
    for k in range(folds):
        rest, own = train.where(fold != k), train.where(fold == k)
        if rest.select(label).distinct().count() > 1:
            parts.append(build.fit(rest).transform(own).select(label, "rawPrediction"))
    return Calibrated(build.fit(train), *_margin_map(reduce(DataFrame.unionByName, parts), label))


class Calibrated(Model, MLReadable, MLWritable):
    """Adds ``p``, the logistic of a scaled margin."""

    def __init__(self, model: Model, slope: float, offset: float) -> None:
        super().__init__()
        self.model, self.slope, self.offset = model, slope, offset

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = vector_to_array("rawPrediction")[1] * self.slope + self.offset
        return self.model.transform(dataset).withColumn("p", 1 / (1 + F.exp(-z)))

    def write(self) -> MLWriter:
        return _CalibratedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CalibratedReader()


class _CalibratedWriter(MLWriter):
    def __init__(self, model: Calibrated) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"slope": m.slope, "offset": m.offset})
        m.model.write().overwrite().save(f"{path}/model")


class _CalibratedReader(MLReader):
    def load(self, path: str) -> Calibrated:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = Calibrated(PipelineModel.load(f"{path}/model"), metadata["slope"], metadata["offset"])
        model._resetUid(metadata["uid"])
        return model


def _with_embedding(columns: list[str], size: int) -> list:
    return [TokenVectors(dims=size), VectorSizeHint(inputCol="embedding", size=size), *_scaled([*columns, "embedding"])]


def ensemble(rules: str = "rules", size: int = 128) -> Pipeline:
    """Rule score and embedding stacked into a logistic regression."""
    return Pipeline(stages=[*_with_embedding([rules], size), LogisticRegression(maxIter=100, regParam=1e-3)])


def multifeature_mlp(columns: list[str], size: int = 256, hidden: tuple[int, ...] = (128, 64), seed: int = 1337) -> Pipeline:
    """Embedding and engineered features into a perceptron."""
    net = MultilayerPerceptronClassifier(layers=[len(columns) + size, *hidden, 2], seed=seed, maxIter=60)
    return Pipeline(stages=[*_with_embedding(columns, size), net])


def conv_embedding_mlp(size: int = 128, hidden: tuple[int, ...] = (128,), seed: int = 1337) -> Pipeline:
    """Byte convolution and embedding, scaled, into a perceptron."""
    net = MultilayerPerceptronClassifier(layers=[2 * size, *hidden, 2], seed=seed, maxIter=200)
    return Pipeline(stages=[ByteConvolution(size=size), VectorSizeHint(inputCol="bytes", size=size), TokenVectors(dims=size), VectorSizeHint(inputCol="embedding", size=size), *_scaled(["bytes", "embedding"]), net])


#: Detectors by name: a function that builds the pipeline to fit.
DETECTORS: dict[str, Callable[..., Pipeline]] = {
    "tfidf_logreg": tfidf_logreg, "tfidf_svm": tfidf_svm, "features_logreg": features_logreg, "features_mlp": features_mlp, "ensemble": ensemble, "multifeature_mlp": multifeature_mlp,
    "conv_embedding_mlp": conv_embedding_mlp,
}


def detector(name: str, **settings: object) -> Pipeline:
    if name not in DETECTORS:
        raise ValueError(f"no detector {name!r}; there are {sorted(DETECTORS)}")
    return DETECTORS[name](**settings)


def search(build: Callable[..., Pipeline], grid: list[dict[str, object]], train: DataFrame, held_out: DataFrame, key: str = "row_id", label: str = "label") -> DataFrame:
    """Fit every setting of a grid: ``trial, settings, auprc, auroc`` on the held-out rows, best first (average precision, then order)."""
    rows = None
    for i, settings in enumerate(grid):
        scored = probabilities(build(**settings).fit(train), held_out).select(F.lit(i).alias("trial"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), F.col(label).cast("int").alias("y"), "p")
        rows = scored if rows is None else rows.unionByName(scored)
    t = curves.score_table(rows, ["trial", "settings"]).groupBy("trial", "settings")
    return t.agg(curves.average_precision().alias("auprc"), curves.auroc().alias("auroc")).orderBy(F.desc("auprc"), "trial")


#: Ranges of settings: ("log", low, high), ("uniform", low, high), ("int", low, high) or ("choice", value, ...).
Space = dict[str, tuple]


def drawn(space: Space, seed: int, trial: int) -> dict[str, object]:
    """Settings of a trial: they depend on seed and number only."""
    rng = random.Random(f"{seed}:{trial}")
    one = {"log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b))), "uniform": rng.uniform, "int": rng.randint, "choice": lambda *v: rng.choice(v)}
    return {name: one[kind](*rest) for name, (kind, *rest) in sorted(space.items())}


HISTORY = "rung int, trial int, share double, settings string, auprc double, auroc double"


def halving_search(
    build: Callable[..., Pipeline], space: Space, train: DataFrame, held_out: DataFrame, path: str, trials: int = 9, eta: int = 3, seed: int = 1337, key: str = "row_id", label: str = "label"
) -> DataFrame:
    """Successive halving: all trials on a small share of the rows, the best ``1 / eta`` of them on ``eta`` times as many, until all rows.

    Shares are nested, by a hash of ``key``. A trial's result (average precision, then area,
    then number) on the held-out rows is written below ``path`` as soon as it is known; a
    restart fits only what is not there. Returns the history, with the rung of each fit.
    """
    spark = train.sparkSession
    rungs = 1 + int(math.log(trials, eta) + 1e-9)
    left, rows = list(range(trials)), []
    for rung in range(rungs):
        share = float(eta) ** (rung + 1 - rungs)
        part = train.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < round(share * 1_000_000))
        told = []
        for trial in left:
            at, settings = f"{path}/{rung}-{trial}", drawn(space, seed, trial)
            if not is_done(spark, at):
                scored = probabilities(build(**settings).fit(part), held_out).select(F.lit(trial).alias("trial"), F.col(label).cast("int").alias("y"), "p")
                got = curves.score_table(scored, ["trial"]).groupBy("trial").agg(curves.average_precision().alias("auprc"), curves.auroc().alias("auroc"))
                got = got.select(F.lit(rung).alias("rung"), "trial", F.lit(share).alias("share"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), "auprc", "auroc")
                got.coalesce(1).write.mode("overwrite").parquet(at)
            told.append(spark.read.schema(HISTORY).parquet(at).first())
        rows += told
        told.sort(key=lambda r: (-(r.auprc or 0.0), -(r.auroc or 0.0), r.trial))
        left = [r.trial for r in told[: max(1, len(told) // eta)]]
    return spark.createDataFrame(rows, HISTORY)


def save(model: Model, path: str, config: dict[str, object]) -> None:
    """Write a fitted pipeline and the settings it was built with, over what is there."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(path: str) -> tuple[Model, dict[str, object]]:
    """A written model, of the class that its metadata name, and its settings."""
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", SparkSession.active()), json.loads(SparkSession.active().read.text(f"{path}/config").first()[0])


ABLATIONS = ("no_rules", "no_embedding", "no_features", "no_retrieval", "no_veto", "constant_prior")


def ablate(df: DataFrame, ablation: str, groups: dict[str, list[str]]) -> DataFrame:
    """Neutralise one branch: its feature columns become 0, with ``constant_prior`` all branches' do. Unknown names raise."""
    if ablation == "constant_prior":
        every = {c for own in groups.values() for c in own}
        return df.select(*(F.lit(0.0).alias(c) if c in every else F.col(c) for c in df.columns))
    branch = ablation.removeprefix("no_")
    if branch not in groups:
        raise ValueError(f"no branch {branch!r}; there are {sorted(groups)}")
    return df.select(*(F.lit(0.0).alias(c) if c in groups[branch] else F.col(c) for c in df.columns))
