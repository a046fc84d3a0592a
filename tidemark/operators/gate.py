"""A logistic gate on vectors: fitted once on labelled rows, applied as a column expression."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """The coefficients of a fitted gate. One without coefficients says 0 for every row."""

    coefficients: tuple[float, ...] = ()
    intercept: float = 0.0

    def probability(self, vector: Column) -> Column:
        """The probability of the positive class; 0 where the gate is not fitted or the vector is null or of another length."""
        if not self.coefficients:
            return F.lit(0.0)
        weights = F.array(*[F.lit(w) for w in self.coefficients])
        dot = F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(self.intercept), lambda s, x: s + x)
        return F.coalesce(F.when(F.size(vector) == len(self.coefficients), 1 / (1 + F.exp(-dot))), F.lit(0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        """place, coefficient; the intercept stands at place -1."""
        return spark.createDataFrame([(-1, self.intercept), *enumerate(self.coefficients)], "place int, coefficient double")

    @classmethod
    def of(cls, table: DataFrame) -> Gate:
        values = {r["place"]: r["coefficient"] for r in table.collect()}  # a row a dimension
        return cls(tuple(values[k] for k in sorted(values) if k >= 0), values.get(-1, 0.0))


def fit(rows: DataFrame, vector: str, label: str, c: float = 1.0, balanced: bool = True) -> Gate:
    """L2-regularised logistic regression; the intercept is free.  ``c`` weighs the rows' losses against the penalty, and
    ``balanced`` gives both classes the same weight in all.

    Rows without a vector or a label don't count; with one class only there is no gate.  The sums of each step run on
    the executors; a step sends the coefficients out and the gradient back."""
    used = rows.filter(F.col(vector).isNotNull() & F.col(label).isin(0, 1)).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    n = {int(r["label"]): r["count"] for r in used.groupBy("label").count().collect()}  # two rows
    if len(n) < 2:
        return Gate()
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])) if balanced else F.lit(1.0)
    model = LogisticRegression(regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=1000, tol=1e-12).fit(used.withColumn("weight", weight))
    return Gate(tuple(float(w) for w in model.coefficients), float(model.intercept))


def sweep(rows: DataFrame, score: str, label: str, thresholds: Iterable[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall and f1 of ``score >= threshold``, for all thresholds in one pass: rows
    are counted between thresholds, and the counts summed from the top."""
    cuts = sorted(set(thresholds))
    place = F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score)))  # how many thresholds the row meets
    spark = rows.sparkSession
    counts = rows.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(place.alias("place")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    every = spark.createDataFrame([(0, None), *[(k + 1, t) for k, t in enumerate(cuts)]], "place int, threshold double").join(F.broadcast(counts), "place", "left").fillna(0, ["p", "q"])
    up, all_ = Window.orderBy(F.desc("place")), Window.partitionBy()  # a row a threshold
    sums = every.select("threshold", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(all_).alias("n1"), F.sum("q").over(all_).alias("n0")).filter("threshold is not null")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n1") - F.col("tp")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return sums.select("threshold", "tp", "fp", fn.alias("fn"), (F.col("n0") - fp).alias("tn"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(swept: DataFrame, least_recall: float = 0.0) -> float:
    """The threshold with the best F1 among those of enough recall (the lowest of equals); the lowest of all if none has."""
    rows = sorted((r["threshold"], r["recall"], r["f1"]) for r in swept.collect())  # a row a threshold
    fit_ = [r for r in rows if r[1] >= least_recall]
    return max(fit_, key=lambda r: (r[2], -r[0]))[0] if fit_ else rows[0][0]
