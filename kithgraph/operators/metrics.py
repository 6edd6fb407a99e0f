"""Aggregates and metrics over frames with user_id, item_id, label (0/1) and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom (fixed values); 2.0 up to 120, 1.96 above.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t95(n: Column) -> Column:
    return F.when(n <= 1, None).when(n <= 31, F.get(F.array(*[F.lit(x) for x in T95]), (n - 2).cast("int"))).when(n <= 121, 2.0).otherwise(1.96)


def t95_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN NULL WHEN {n} <= 31 THEN ([{', '.join(map(str, T95))}])[CAST({n} - 1 AS BIGINT)] WHEN {n} <= 121 THEN 2.0 ELSE 1.96 END"


def std_error95(x: Column) -> Column:
    """The half width of the 95 % interval of a mean; null for one value."""
    return t95(F.count(x)) * F.stddev_samp(x) / F.sqrt(F.count(x))


def exact_mean(x: Column) -> Column:
    """A mean that does not depend on the order of addition: values are summed to 18 places."""
    return F.sum(x.cast("decimal(28,18)")).cast("double") / F.count(x)


def exact_error95(x: Column) -> Column:
    """std_error95 with a deviation that does not depend on the order of addition."""
    n, square = F.count(x), F.sum((x * x).cast("decimal(28,18)")).cast("double")
    mean = exact_mean(x)
    return F.when(n > 1, t95(n) * F.sqrt(F.greatest(square - n * mean * mean, F.lit(0.0)) / (n - 1)) / F.sqrt(n))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    hit = F.col("score") >= threshold
    one = lambda c: F.sum(c.cast("int")).cast("long")
    return df.groupBy(*by).agg(one(hit & (F.col("label") == 1)).alias("tp"), one(hit & (F.col("label") == 0)).alias("fp"), one(~hit & (F.col("label") == 0)).alias("tn"), one(~hit & (F.col("label") == 1)).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and the accuracy's 2-sigma half width from tp, fp, tn, fn."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    a = ratio(F.col("tp") + F.col("tn"), n)
    return counts.withColumns({"accuracy": a, "ci": 2 * F.sqrt(ratio(a * (1 - a), n)), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def macro(df: DataFrame, threshold: float) -> DataFrame:
    """Means over users with their standard errors (population deviation over root n)."""
    per = rates(confusion(df, threshold, "user_id"))
    out = []
    for m in ("accuracy", "precision", "recall", "f1"):
        out += [F.avg(m).alias(m), (F.stddev_pop(m) / F.sqrt(F.count("*"))).alias(f"{m}_se")]
    return per.agg(F.count("*").alias("n_users"), *out)


def _grid(spark, low: int, high: int) -> DataFrame:
    return spark.range(low, high + 1).select(F.col("id").alias("k"))


def sweep(df: DataFrame, low: int = -100, high: int = 99) -> DataFrame:
    """k, tp, fp, p, n for thresholds k/10: one pass that counts rows by the last threshold they pass, then running sums.

    The running sums go over the grid, whose size is fixed.
    """
    last = F.least(F.floor(F.round(F.col("score") * 10, 9)), F.lit(high)).cast("long")
    counted = df.groupBy(last.alias("k")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    grid = _grid(df.sparkSession, low, high).join(F.broadcast(counted), "k", "left")  # counted has at most one row a threshold below `high`
    totals = df.agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("k", F.sum(F.coalesce("pos", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(w).alias("fp")).crossJoin(totals)


def best_threshold(df: DataFrame) -> DataFrame:
    """The first threshold k/10 of -10..9.9 with the greatest micro F1."""
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    return sweep(df).withColumn("f1", f1).agg(F.max(F.struct(F.col("f1"), (-F.col("k")).alias("nk"))).alias("b")).select((-F.col("b.nk") / 10.0).alias("threshold"), F.col("b.f1").alias("f1"))


def best_macro_threshold(df: DataFrame) -> DataFrame:
    """The first threshold k/10 of -10..9.9 with the greatest mean of both classes' F1."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    f1 = (ratio(2 * tp, tp + fp + p) + ratio(2 * (n - fp), 2 * n - fp + p - tp)) / 2
    return sweep(df).withColumn("f1", f1).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("k")).alias("nk"))).alias("b")).select((-F.col("b.nk") / 10.0).alias("threshold"), F.col("b.f1").alias("f1"))


def roc(df: DataFrame, points: int = 20) -> DataFrame:
    """False and true positive rates at equal-width thresholds from the greatest score down to the least.

    A row is counted at the first threshold that it reaches; running sums over the points do the rest.
    """
    bounds = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    limits = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.col("hi") - (F.col("hi") - F.col("lo")) * i / points)
    grid = bounds.withColumn("limits", limits)  # one row
    step = F.size(F.filter("limits", lambda t: t > F.col("score"))).cast("long")
    counted = df.select("score", "label").crossJoin(F.broadcast(grid)).groupBy(step.alias("step")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = grid.select("p", "n", F.posexplode("limits").alias("at", "t")).withColumn("step", F.col("at").cast("long"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    return steps.join(F.broadcast(counted), "step", "left").select("step", ratio(run("neg"), F.col("n")).alias("fpr"), ratio(run("pos"), F.col("p")).alias("tpr"))


def auc(points: DataFrame) -> DataFrame:
    """Trapezoids between ROC points, from (0, 0) on; gini = 2 auc - 1."""
    w = Window.orderBy("step")
    x = points.select("fpr", "tpr", F.coalesce(F.lag("fpr").over(w), F.lit(0.0)).alias("x0"), F.coalesce(F.lag("tpr").over(w), F.lit(0.0)).alias("y0"))
    return x.agg(F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2).alias("auc")).withColumn("gini", 2 * F.col("auc") - 1)


def right_minus_wrong(df: DataFrame, threshold: float) -> DataFrame:
    ok = (F.col("score") >= threshold).cast("int") == F.col("label")
    return df.agg(F.sum(F.when(ok, 1).otherwise(-1)).cast("long").alias("value"), F.sum(ok.cast("int")).cast("long").alias("n_right"), F.sum((~ok).cast("int")).cast("long").alias("n_wrong"))


def average_precision(df: DataFrame, ascending: bool = False) -> DataFrame:
    """Mean of hits/rank at each hit, for each user with a hit. Ties by item."""
    order = F.asc("score") if ascending else F.desc("score")
    w = Window.partitionBy("user_id").orderBy(order, "item_id")
    ranked = df.withColumns({"rank": F.row_number().over(w), "hits": F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where("label = 1").groupBy("user_id").agg(F.avg(F.col("hits") / F.col("rank")).alias("ap"), F.count("*").alias("n_hits"))


def map_summary(ap: DataFrame) -> DataFrame:
    return ap.agg(F.count("*").alias("n_users"), F.avg("ap").alias("map"), F.stddev_pop("ap").alias("sd"), (F.stddev_pop("ap") / F.sqrt(F.count("*"))).alias("se"))


def evaluated(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, tn, fn and their rates at the threshold, and the mean average precision over users with a liked row (0 without any)."""
    ap = map_summary(average_precision(scored)).select(F.coalesce("map", F.lit(0.0)).alias("map"))
    counts = confusion(scored, threshold).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return rates(counts).crossJoin(F.broadcast(ap))  # one row each


def precision_recall_at(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    top = df.withColumn("rank", F.row_number().over(w)).groupBy("user_id").agg(F.sum(F.when(F.col("rank") <= n, F.col("label")).otherwise(0)).alias("hits"), F.sum("label").alias("pos"), F.sum((F.col("rank") <= n).cast("int")).alias("shown"))
    return top.agg(ratio(F.sum("hits"), F.sum("shown")).alias("precision_at"), ratio(F.sum("hits"), F.sum("pos")).alias("recall_at"))


def errors(df: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """RMSE and MAE of score against rating, clamped."""
    e = F.greatest(F.lit(low), F.least(F.lit(high), F.col("score"))) - F.col("rating")
    return df.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def wilson(df: DataFrame, *by: str, z: float = 1.96) -> DataFrame:
    """The share of label 1 with its Wilson interval."""
    x = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("p"))
    mid = (F.col("p") + z * z / (2 * F.col("n"))) / (1 + z * z / F.col("n"))
    half = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n"))) / (1 + z * z / F.col("n"))
    return x.select(*by, "n", "p", (mid - half).alias("low"), (mid + half).alias("high"))


def information(df: DataFrame, feature: str = "feature", smoothing: float = 0.0) -> DataFrame:
    """From feature, x (0/1), y (0/1): the 2x2 counts, H(Y | X=1) and the mutual information, base 2."""
    c = lambda x, y: (F.sum(((F.col("x") == x) & (F.col("y") == y)).cast("int")) + smoothing).cast("double")
    t = df.groupBy(feature).agg(c(1, 1).alias("n11"), c(1, 0).alias("n10"), c(0, 1).alias("n01"), c(0, 0).alias("n00"))
    n11, n10, n01, n00 = (F.col(x) for x in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    h = lambda a, b: -(F.when(a > 0, ratio(a, a + b) * F.log2(ratio(a, a + b))).otherwise(0.0) + F.when(b > 0, ratio(b, a + b) * F.log2(ratio(b, a + b))).otherwise(0.0))
    mi = lambda k, r, s: F.when(k > 0, k / n * F.log2(k * n / (r * s))).otherwise(0.0)
    return t.select(feature, *(x.cast("long").alias(y) for x, y in ((n11, "n11"), (n10, "n10"), (n01, "n01"), (n00, "n00"))), h(n11, n10).alias("entropy_true"), (mi(n11, n11 + n10, n11 + n01) + mi(n10, n11 + n10, n10 + n00) + mi(n01, n01 + n00, n11 + n01) + mi(n00, n01 + n00, n10 + n00)).alias("mutual_information"))


def fold_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean over folds with the population deviation over root n, and the 95 % half width."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("se"), std_error95(F.col(value)).alias("se95"))
