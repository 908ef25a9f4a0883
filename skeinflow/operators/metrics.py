"""Evaluation of labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Dense confusion matrix: y_true, y_pred, n for every pair of ``classes``, zeros included."""
    counts = df.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.lit(list(classes))).alias("y_true")).select("y_true", F.explode(F.lit(list(classes))).alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn and support per class that occurs as truth or prediction (one pass, two rows per wrong row)."""
    hit = (F.col(truth) == F.col(pred)).cast("long")
    miss = 1 - hit
    zero = F.lit(0).cast("long")
    as_true = F.struct(F.col(truth).alias("class"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn"), F.lit(1).cast("long").alias("support"))
    as_pred = F.struct(F.col(pred).alias("class"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn"), zero.alias("support"))
    rows = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*by, F.explode(F.array(as_true, as_pred)).alias("c"))
    return rows.groupBy(*by, "c.class").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn", "support")])


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, 0 where a denominator is 0."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy, macro-F1 over classes with support, and support-weighted F1."""
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n_rows"),
        (F.sum("tp") / F.greatest(F.sum("support"), F.lit(1))).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))).alias("weighted_f1"),
    )


def pooled_binary(df: DataFrame, truth: str, pred: str, positive: Sequence[int]) -> DataFrame:
    """One binary problem of a set of classes: tp, fp, fn, precision, recall, f1."""
    t, p = F.col(truth).isin(list(positive)), F.col(pred).isin(list(positive))
    out = df.agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))])
    return scores(out)


def worst_classes(scored: DataFrame, k: int) -> DataFrame:
    return scored.where("support > 0").orderBy("f1", "class").limit(k)


def row_normalised(cm: DataFrame, top: int = 3) -> DataFrame:
    """Share of each predicted class among a true class, the ``top`` largest per true class, with their rank."""
    total = F.sum("n").over(W.partitionBy("y_true"))
    share = cm.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))
    return share.withColumn("rank", F.row_number().over(W.partitionBy("y_true").orderBy(F.desc("n"), "y_pred"))).where(F.col("rank") <= top)


def softmax(values: Column) -> Column:
    """Softmax of an array column."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def biased_argmax(values: Column, bias: Sequence[float]) -> Column:
    return argmax(F.zip_with(values, F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b))


def bootstrap(df: DataFrame, truth: str, pred: str, classes: Sequence[int], reps: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Confidence interval of accuracy and macro-F1.

    Resampling happens on the cells of the confusion matrix: drawing n rows with
    replacement is a multinomial draw over cells, made as Poisson draws of each
    cell by repetition. So the data is read once however many repetitions there are,
    and ``reps`` rows per cell are all that is shuffled. Returns metric, point, low, high;
    the interval is widened to hold the point estimate.
    """
    import numpy as np
    import pandas as pd

    cells = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))

    def draw(batches):
        for b in batches:
            for t, p, n in b.itertuples(index=False):
                rng = np.random.default_rng([seed, int(t) & 0xFFFF, int(p) & 0xFFFF])
                yield pd.DataFrame({"rep": np.arange(reps + 1), "t": t, "p": p, "n": np.concatenate([[n], rng.poisson(n, reps)])})

    drawn = cells.mapInPandas(draw, "rep int, t long, p long, n long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    miss = F.col("n") - hit
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("t").alias("class"), hit.cast("long").alias("tp"), zero.alias("fp"), miss.alias("fn"), F.col("n").alias("support")),
        F.struct(F.col("p").alias("class"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn"), zero.alias("support")),
    )
    counts = drawn.select("rep", F.explode(both).alias("c")).groupBy("rep", "c.class").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn", "support")])
    per_rep = summary(scores(counts), ["rep"])
    long = per_rep.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "macro_f1")])).alias("m")).select("rep", "m.*")
    tail = (1 - level) / 2
    low, high = (F.percentile(F.when(F.col("rep") > 0, F.col("v")), F.lit(q)) for q in (tail, 1 - tail))
    point = F.max(F.when(F.col("rep") == 0, F.col("v")))
    return long.groupBy("metric").agg(point.alias("point"), F.least(low, point).alias("low"), F.greatest(high, point).alias("high"))


def calibrate_bias(df: DataFrame, truth: str, scores_col: str, n_classes: int, rounds: int = 12, half_width: float = 6.0, points: int = 25, shrink: float = 0.6) -> list[float]:
    """Per-class additive bias that raises macro-F1: coordinate ascent over a shrinking grid.

    For one class all candidate biases are scored in one distributed pass: with the
    others fixed, a row's prediction is either the class or its best other class, so
    a row adds to 2 * points counters, aggregated map-side. Only those counters reach
    the driver. Ties go to the smaller absolute bias; the zero bias is always a candidate, so the result never
    scores below it on the given rows.
    """
    bias = [0.0] * n_classes
    width = half_width
    for _ in range(rounds):
        for c in range(n_classes):
            grid = sorted({0.0, bias[c], *[width * (2 * i / (points - 1) - 1) + bias[c] for i in range(points)]}, key=lambda b: (abs(b), b))
            others = F.transform(F.col(scores_col), lambda x, i: F.when(i == c, F.lit(float("-inf"))).otherwise(x + F.element_at(F.lit(bias), i + 1)))
            rows = df.select(truth, F.element_at(scores_col, c + 1).alias("own"), argmax(others).alias("other"), F.array_max(others).alias("best"))
            wins = F.array(*[F.struct(F.lit(g).alias("bias"), ((F.col("own") + g > F.col("best")) | ((F.col("own") + g == F.col("best")) & (F.lit(c) < F.col("other")))).alias("win")) for g in grid])
            tried = rows.withColumn("g", F.explode(wins)).select(truth, F.col("g.bias").alias("bias"), F.when(F.col("g.win"), c).otherwise(F.col("other")).alias("pred"))
            result = {r["bias"]: r["macro_f1"] for r in summary(scores(class_counts(tried, truth, "pred", ["bias"])), ["bias"]).collect()}
            if result:
                bias[c] = max(grid, key=lambda b: (round(result[b], 12), -abs(b)))
        width *= shrink
    return bias


def bootstrap_mean(df: DataFrame, by: str, value: str, reps: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """by, mean, low, high: a group's mean with a bootstrap interval; null and NaN values do not count.

    Rows of one group and value are interchangeable, so they are counted first, and each such cell draws one Poisson number a repetition
    with its count as mean, from a seed of its own content: the result does not depend on the partitioning. Per group a task
    keeps one weighted sum and count a repetition, and only those are shuffled after the cells.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)

    def draw(batches):
        held: dict = {}
        for b in batches:
            for g, x, n, h in zip(b[by], b["_x"], b["_n"], b["_h"], strict=True):
                sums, weights = held.setdefault(None if pd.isna(g) else g, (np.zeros(reps + 1), np.zeros(reps + 1)))
                w = np.concatenate([[n], np.random.default_rng([seed, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).poisson(n, reps)])
                sums += w * x
                weights += w
        for g, (sums, weights) in held.items():
            yield pd.DataFrame({by: pd.Series([g] * (reps + 1), dtype="object"), "rep": np.arange(reps + 1), "s": sums, "w": weights})

    x = F.col(value).cast("double")
    cells = df.select(by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    sums = cells.withColumn("_h", F.xxhash64(by, "_x")).mapInPandas(draw, f"`{by}` {kinds[by]}, rep int, s double, w double")
    per = sums.groupBy(by, "rep").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    point = F.max(F.when(F.col("rep") == 0, F.col("m")))
    low, high = (F.percentile(F.when(F.col("rep") > 0, F.col("m")), F.lit(q)) for q in (tail, 1 - tail))
    return per.groupBy(by).agg(point.alias("mean"), F.least(low, point).alias("low"), F.greatest(high, point).alias("high"))
