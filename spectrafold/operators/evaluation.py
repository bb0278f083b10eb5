"""Metrics of predicted scores and classes.

Curve areas need the scores in order.  Equal scores are counted first, by class;
ranges of (class, score) then carry running counts, and the counts of the ranges
passed before come from one small table, so no task sorts a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.session import cut_lineage


def ranking_metrics(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """By group: positives, negatives, the area under the ROC curve and the average precision.

    Equal scores are one threshold.  Both areas are null in a group without
    positives or without negatives.  Rows whose score or truth is null are left out.
    """
    keyed = df.select(F.struct(F.lit(0).alias("__none"), *by).alias("g"), positive.alias("y"), score.cast("double").alias("s")).where("y IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    counted = keyed.groupBy("g", "s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    ranged = cut_lineage(counted.repartitionByRange("g", F.desc("s")).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("g", "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    order = W.partitionBy("g").orderBy("part")
    all_of = W.partitionBy("g")
    before = parts.select("g", "part", (F.sum("p").over(order) - F.col("p")).alias("p0"), (F.sum("n").over(order) - F.col("n")).alias("n0"), F.sum("p").over(all_of).alias("P"), F.sum("n").over(all_of).alias("N"))
    inner = W.partitionBy("g", "part").orderBy(F.desc("s"))
    rows = ranged.withColumns({"tp": F.sum("pos").over(inner), "fp": F.sum("neg").over(inner)}).join(before, ["g", "part"])
    tp, fp = F.col("tp") + F.col("p0"), F.col("fp") + F.col("n0")
    out = rows.groupBy("g").agg(
        F.max("P").alias("n_positive"), F.max("N").alias("n_negative"),
        F.sum(F.col("neg") * (tp - F.col("pos") / 2)).alias("above"), F.sum(F.col("pos") * tp / (tp + fp)).alias("precise"),
    )
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    auroc = F.when(both, F.col("above") / (F.col("n_positive") * F.col("n_negative")))
    return out.select("g.*", "n_positive", "n_negative", auroc.alias("auroc"), F.when(both, F.col("precise") / F.col("n_positive")).alias("auprc")).drop("__none")


def class_counts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class that is true or predicted somewhere: support, predicted, hits, precision, recall and f1, 0 where a share has no base."""
    pairs = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted")), F.struct(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted")))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    each = pairs.select(hit.alias("hit"), F.inline(sides))
    out = each.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum(F.when(F.col("support") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumns({"precision": share("hits", "predicted"), "recall": share("hits", "support")})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def classification_summary(df: DataFrame, label: str, predicted: str, average: str = "weighted", positive=1) -> DataFrame:
    """Accuracy, balanced accuracy and averaged precision, recall and f1.

    ``average`` is ``binary`` (of the class ``positive``; weighted instead with more
    than two classes), ``micro``, ``macro`` or ``weighted`` by support.
    """
    if average not in ("binary", "micro", "macro", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    counts = class_counts(df, label, predicted)
    there = F.count_if(F.col("support") > 0)
    told = [F.sum("support").alias("n"), there.alias("n_classes"), (F.sum("hits") / F.sum("support")).alias("accuracy"), (F.sum(F.when(F.col("support") > 0, F.col("recall"))) / there).alias("balanced_accuracy")]
    for m in ("precision", "recall", "f1"):
        weighted = F.sum(F.col(m) * F.col("support")) / F.sum("support")
        one = F.coalesce(F.max(F.when(F.col("class").cast("string") == F.lit(positive).cast("string"), F.col(m))), F.lit(0.0))
        how = {"weighted": weighted, "macro": F.avg(m), "micro": F.sum("hits") / F.sum("support"), "binary": F.when(there > 2, weighted).otherwise(one)}
        told.append(how[average].alias(m))
    return counts.agg(*told)


def predicted_class(scores: dict[object, Column]) -> Column:
    """The class of the largest score, the first of equal ones; scores that are null or no numbers lose."""
    clean = {k: F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("double")).otherwise(F.lit(float("-inf"))) for k, c in scores.items()}
    most = F.greatest(*clean.values()) if len(clean) > 1 else next(iter(clean.values()))
    return reduce(lambda rest, k: F.when(clean[k] == most, F.lit(k)).otherwise(rest), reversed(list(clean)), F.lit(None))


def probability_metrics(df: DataFrame, label: str, scores: dict[object, Column]) -> DataFrame:
    """Of scores by class: accuracy, balanced accuracy, macro f1, macro AUROC and AUPRC, and the classes without areas.

    The macro areas are null if any class lacks positives or negatives, so that
    their population never changes silently.  The scores are read once for the
    classes and once for the areas.
    """
    told = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), predicted_class(scores).alias("predicted"), *[c.cast("double").alias(f"s{i}") for i, c in enumerate(scores.values())])
    counts = class_counts(told, "label", "predicted")
    classes = F.array(*[F.lit(k) for k in scores])
    summary = counts.agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.when(F.col("support") > 0, F.col("recall"))) / F.count_if(F.col("support") > 0)).alias("balanced_accuracy"),
        (F.sum(F.when(F.array_contains(classes, F.col("class")), F.col("f1"))) / len(scores)).alias("macro_f1"),
    )
    long = told.select("label", F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"s{i}").alias("score")) for i, k in enumerate(scores)])))
    areas = ranking_metrics(long, F.col("label") == F.col("class"), F.col("score"), ["class"])
    defined = F.count("auroc") == len(scores)
    lacking = F.array_sort(F.collect_list(F.when(F.col("auroc").isNull(), F.col("class").cast("string"))))
    macro = areas.agg(F.when(defined, F.avg("auroc")).alias("macro_auroc"), F.when(defined, F.avg("auprc")).alias("macro_auprc"), lacking.alias("undefined"))
    return summary.crossJoin(F.broadcast(macro))
