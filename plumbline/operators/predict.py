"""Scoring tables with user-supplied models, and linear heads on frozen vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from plumbline.operators.lineage import checkpointed, is_small, shared_folder


def batch_predict(rows: DataFrame, key: str, features: str, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], k: int = 5, batch: int = 1024) -> DataFrame:
    """(key, top): the k best classes of each row as structs (class_id, score), best first, ties to the lower id.

    factory() loads the model once in each Python worker's task; it maps a feature matrix to a score matrix.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                scores = np.asarray(model(np.array(part[features].tolist(), float)), float)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({key: part[key], "top": [[{"class_id": int(c), "score": float(s[c])} for c in b] for b, s in zip(best, scores, strict=True)]})

    return rows.select(key, features).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, top array<struct<class_id int, score double>>")


def joint_predict(
    rows: DataFrame, key: str, features: str, factory: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]], taxonomy: DataFrame, k: int = 5, detections: DataFrame | None = None, batch: int = 1024
) -> DataFrame:
    """(key, top, host, category, detections): what a classifier with three heads and a detector say of each row, nested.

    factory() loads a model that maps a feature matrix to scores of classes, hosts and categories. top: the k best classes
    (class_id, name, host, category, probability); host and category: those of the best class, with the largest probability of
    their own heads. taxonomy: (class_id, name, host, category), a dimension. detections: rows of ``key`` (det_id, label, class_id,
    name, host, score, xmin..ymax), as boxes.postprocess and taxonomy.map_predictions give them, best first in the result.
    """

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                p, host, category = (softmax(np.asarray(z, float)) for z in model(np.array(part[features].tolist(), float)))
                best = np.argsort(-p, axis=1, kind="stable")[:, :k]
                top = [[{"rank": r, "class_id": int(c), "probability": round(float(s[c]), 6)} for r, c in enumerate(b)] for b, s in zip(best, p, strict=True)]
                yield pd.DataFrame({key: part[key], "top": top, "host_p": host.max(axis=1).round(6), "category_p": category.max(axis=1).round(6)})

    kind = rows.schema[key].dataType.simpleString()
    scored = rows.select(key, features).mapInPandas(run, f"{key} {kind}, top array<struct<rank int, class_id int, probability double>>, host_p double, category_p double")
    names = checkpointed(taxonomy.select("class_id", F.struct("name", "host", "category").alias("names")))
    entry = lambda x, n: F.struct(x["rank"].alias("rank"), x["class_id"].alias("class_id"), *(n[c].alias(c) for c in ("name", "host", "category")), x["probability"].alias("probability"))
    if is_small(names):  # one row with all names goes to every task; rows are named where they are
        book = names.agg(F.map_from_entries(F.collect_list(F.struct("class_id", "names"))).alias("book"))
        out = scored.crossJoin(F.broadcast(book)).select(key, "host_p", "category_p", F.transform("top", lambda x: entry(x, F.col("book")[x["class_id"]])).alias("t"))
    else:
        rows_ = checkpointed(scored.withColumn("__row", F.monotonically_increasing_id()))  # rows that repeat a key stay apart
        named = rows_.select("__row", F.explode("top").alias("x")).join(names.select(F.col("class_id").alias("__class"), "names"), F.col("x.class_id") == F.col("__class"), "left")
        tops = named.groupBy("__row").agg(F.array_sort(F.collect_list(entry(F.col("x"), F.col("names")))).alias("t"))
        out = rows_.drop("top").join(tops, "__row", "left").drop("__row")
    first = F.get("t", F.lit(0))
    out = out.select(
        key, F.transform("t", lambda x: x.dropFields("rank")).alias("top"),
        F.struct(first["host"].alias("host"), F.col("host_p").alias("probability")).alias("host"), F.struct(first["category"].alias("category"), F.col("category_p").alias("probability")).alias("category"),
    )
    box = F.struct((-F.col("score")).alias("minus"), "det_id", "label", "class_id", "name", "host", F.array("xmin", "ymin", "xmax", "ymax").alias("box"))
    if detections is None:
        return out.withColumn("detections", F.array().cast("array<struct<label:int,class_id:int,name:string,host:string,score:double,box:array<double>>>"))
    lists = detections.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("d"))
    shown = F.transform("d", lambda x: F.struct(x["label"].alias("label"), x["class_id"].alias("class_id"), x["name"].alias("name"), x["host"].alias("host"), (-x["minus"]).alias("score"), x["box"].alias("box")))
    return out.join(lists, key, "left").withColumn("detections", F.coalesce(shown, F.array())).drop("d")


def _head(rows: DataFrame, features: str, target: str, weight: str | None, iterations: int, penalty: float) -> tuple[LogisticRegressionModel, DataFrame]:
    """A multinomial linear head of ``target`` fitted on frozen vectors, and the rows that it was fitted on, as it reads them."""
    data = rows.withColumn("__x", array_to_vector(F.transform(features, lambda v: v.cast("double")))).withColumn("__y", F.col(target).cast("double"))
    extra = {"weightCol": weight} if weight else {}
    model = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob", maxIter=iterations, regParam=penalty, family="multinomial", **extra).fit(data)
    return model, data


def without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model, saved to the shared folder and loaded again. A model that was just fitted holds its training summary, and through it the session,
    which tasks can't be sent once any query of the session has used an Observation; a saved model holds its weights only."""
    at = f"{shared_folder(SparkSession.active())}/plumbline/head-{uuid.uuid4().hex}"
    model.save(at)
    return LogisticRegressionModel.load(at)


def linear_probe(rows: DataFrame, features: str, target: str, weight: str | None = None, iterations: int = 30, penalty: float = 1e-3) -> DataFrame:
    """rows with logits (array) and pred of a linear head fitted on frozen vectors, optionally with row weights."""
    model, data = _head(rows, features, target, weight, iterations, penalty)
    out = without_summary(model).transform(data).withColumn("logits", vector_to_array("__raw")).withColumn("pred", F.col("__p").cast("int"))
    return out.drop("__x", "__y", "__p", "__raw", "__prob")


def fit_heads(rows: DataFrame, features: str, heads: dict[str, str], at: str, weight: str | None = None, iterations: int = 30, penalty: float = 1e-3) -> None:
    """Fits a linear head for each target column (heads: name to column) and saves each as a pyspark.ml model, ``at``/<name>. Rows without
    a target or vector are left out. Saved again, a head is replaced."""
    for name, target in heads.items():
        model, _ = _head(rows.where(F.col(target).isNotNull() & F.col(features).isNotNull()), features, target, weight, iterations, penalty)
        model.write().overwrite().save(f"{at}/{name}")


def score_heads(rows: DataFrame, features: str, heads: list[str], at: str, width: int, batch: int = 4096) -> DataFrame:
    """rows with <name>_logits (array) of each saved head, by one pass of batches of ``width``-dimensional vectors over all heads' weights.

    The weights (classes x dimensions, whatever the rows) are read from the saved models once, broadcast, and stacked to one matrix once in a Python
    worker. A row without a vector has null logits.
    """
    models = {name: LogisticRegressionModel.load(f"{at}/{name}") for name in heads}
    weights = rows.sparkSession.sparkContext.broadcast([(n, m.coefficientMatrix.toArray(), m.interceptVector.toArray()) for n, m in models.items()])

    def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        names, matrices, offsets = zip(*weights.value, strict=True)
        matrix, offset = np.concatenate(matrices).T, np.concatenate(offsets)
        ends = np.cumsum([len(m) for m in matrices])[:-1]

        def scores(x: np.ndarray) -> dict[str, np.ndarray]:
            return dict(zip(names, np.split(x.astype(float) @ matrix + offset, ends, axis=1), strict=True))

        return scores

    kind = StructType([StructField(n, ArrayType(DoubleType())) for n in heads])
    udf = predict_batch_udf(make, return_type=kind, batch_size=batch, input_tensor_shapes=[[width]])
    there = F.col(features).isNotNull()
    out = rows.withColumn("__s", udf(F.coalesce(features, F.array_repeat(F.lit(0.0).cast(rows.schema[features].dataType.elementType), width))))
    return out.select(*rows.columns, *(F.when(there, F.col("__s")[n]).alias(f"{n}_logits") for n in heads))
