"""Glyph classification: training with Spark ML, batch scoring with given weights, guarded maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def class_weights(df: DataFrame, features: str, label: str, size: int) -> dict[str, list]:
    """A one-hidden-layer model from class means: one hidden unit per class. Means, spread and
    class means are aggregates; what reaches the driver is one row per class."""
    values = [F.get(features, F.lit(i)).cast("double") for i in range(size)]
    total = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
    mean = [total[f"m{i}"] for i in range(size)]
    std = [total[f"s{i}"] + 1e-3 for i in range(size)]
    rows = df.groupBy(label).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).orderBy(label).collect()
    w1 = [[(r[f"m{i}"] - mean[i]) / std[i] for r in rows] for i in range(size)]
    return {"mean": mean, "std": std, "w1": w1, "classes": [r[label] for r in rows]}


def scorer(model: dict[str, list]) -> Callable[[Column], Column]:
    """Label and probability per vector: standardise, hidden layer with ReLU, softmax. The
    weights are sent to each worker once and unpacked once per batch stream."""

    @F.pandas_udf("label bigint, p double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mean, std, w1 = (np.asarray(model[k]) for k in ("mean", "std", "w1"))
        classes = np.asarray(model["classes"])
        for s in batches:
            x = np.stack(s.to_numpy()).astype("float64")
            z = np.maximum(((x - mean) / std) @ w1, 0)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pd.DataFrame({"label": classes[best], "p": p[np.arange(len(best)), best]})

    return classify


def trained(df: DataFrame, features: str, label: str, hidden: int, steps: int) -> DataFrame:
    """Trains a perceptron on four of five rows, predicts all of them: ``(.., predicted, val)``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumns({
        "_x": array_to_vector(c(features).cast("array<double>")), "_y": c(label).cast("double"),
        "val": F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0,
    })
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(rows.where(~c("val")))
    rows = scaler.transform(rows)
    size, classes = rows.select(F.size(features), F.lit(0)).first()[0], int(rows.agg(F.max(label)).first()[0]) + 1
    model = MultilayerPerceptronClassifier(
        layers=[size, hidden, classes], featuresCol="_z", labelCol="_y", maxIter=steps, seed=7
    ).fit(rows.where(~c("val")))
    out = model.transform(rows)
    return out.select(*df.columns, c("prediction").cast("long").alias("predicted"), "val")


def confusion_report(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, right ones and the three most frequent wrong answers."""
    counts = df.groupBy(label, "predicted").agg(F.count("*").alias("n"))
    text = F.concat(c("predicted").cast("string"), F.lit(":"), c("n").cast("string"))
    wrong = F.when(c("predicted") != c(label), F.struct((-c("n")).alias("k"), "predicted", text.alias("t")))
    return counts.groupBy(label).agg(
        F.sum("n").alias("rows_"),
        F.coalesce(F.sum(F.when(c("predicted") == c(label), c("n"))), F.lit(0)).alias("right_"),
        F.array_join(
            F.transform(F.slice(F.array_sort(F.collect_list(wrong)), 1, 3), lambda w: w["t"]), " "
        ).alias("confused"),  # one entry per class
    )


def guarded(
    df: DataFrame, value: str, work: Callable[[str], int], attempts: str
) -> DataFrame:
    """Runs ``work`` on each row: a failure is recorded with its text, the others go on. Adds
    ``result, ok, error`` and counts the attempt; a retry takes the rows that are not ok."""
    names = [*df.columns, "result", "ok", "error"]
    schema = ", ".join(f"{n} {k}" for n, k in df.dtypes) + ", result bigint, ok boolean, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for v in pdf[value]:
                try:
                    got.append((work(v), True, None))
                except Exception as exc:
                    got.append((None, False, type(exc).__name__))
            out = pdf.assign(result=[g[0] for g in got], ok=[g[1] for g in got], error=[g[2] for g in got])
            out["result"] = out["result"].astype("Int64")
            out[attempts] = out[attempts] + 1
            yield out[names]

    return df.mapInPandas(run, schema)
