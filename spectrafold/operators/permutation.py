"""Permutation tests: labels dealt anew over the rows, draw by draw, in one pass over the table for each digit of an order.

A draw orders the rows by a keyed hash and gives the first label to as many rows
as have it.  Where that cut falls is found digit by digit: rows are counted and
summed by the leading bits of their hash, combined per task, and only rows that
share the cut's bits so far are looked at again, until few are left.  No draw is
ever sorted whole, and what a task sends is bounded by draws and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.inference import shuffled

#: Bits of a digit, digits of an order, and rows of a draw that are put in order at last.
BITS, DIGITS, LAST = 10, 6, 1000
_SUMS = ("n", "s", "q")


def _sums(value: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.coalesce(F.sum(value * value), F.lit(0.0)).alias("q")]


def _statistic(kind: str, n: Column, s: Column, q: Column, all_n: Column, all_s: Column, all_q: Column) -> Column:
    """Of the labelled rows' sums against the others'; null where a side has too few rows."""
    n, all_n = n.cast("double"), all_n.cast("double")  # squares of counts exceed integers
    other = (all_n - n, all_s - s, all_q - q)
    mean = lambda n, s: F.try_divide(s, n)
    gap = mean(n, s) - mean(other[0], other[1])
    if kind == "mean_difference":
        return gap
    if kind != "welch_t":
        raise ValueError(f"no such statistic: {kind}")
    error = lambda n, s, q: F.try_divide(q - F.try_divide(s * s, n), (n - 1) * n)
    return F.try_divide(gap, F.sqrt(F.greatest(error(n, s, q) + error(*other), F.lit(0.0))))


def label_permutations(df: DataFrame, id_col: str, value: str, label: Column, draws: int, statistic: str = "mean_difference") -> DataFrame:
    """``draw`` (0 is the observed labelling, then 1 to ``draws``) and ``statistic``.

    Rows whose value or label is null are left out.  Ids should be unique: rows
    of one id and value stand together in every draw.  An empty table gives
    draws without a statistic.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(value).cast("double").alias("v"), label.alias("g")).dropna()
    whole = rows.agg(*_sums(F.col("v")), *[c.alias(f"g{name}") for name, c in zip(_SUMS, (F.count_if("g"), *[F.coalesce(F.sum(F.when(F.col("g"), x)), F.lit(0.0)) for x in (F.col("v"), F.col("v") * F.col("v"))]))]).first()
    spark = df.sparkSession
    totals = [F.lit(whole[c]) for c in _SUMS]
    # Each row becomes as many as there are draws, so a small file is dealt to all tasks first.
    dealt_out = rows.repartition(spark.sparkContext.defaultParallelism, "id")
    keyed = dealt_out.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("order", F.md5(F.concat_ws(":", "id", F.col("draw").cast("string"))))
    keyed = keyed.withColumn("bits", F.conv(F.substring("order", 1, 15), 16, 10).cast("long"))
    # Of each draw: the leading bits of the cut, rows still to take, and the sums of those taken.
    state = {b: {"prefix": 0, "left": whole["gn"], "n": 0, "s": 0.0, "q": 0.0, "size": whole["n"]} for b in range(1, draws + 1)}
    depth = 0
    while depth < DIGITS and any(x["size"] > LAST for x in state.values()):
        open_ = spark.createDataFrame([(b, x["prefix"]) for b, x in state.items() if x["size"] > LAST], "draw int, prefix long")
        under = keyed.join(F.broadcast(open_), "draw").where(F.shiftright("bits", 60 - BITS * depth) == F.col("prefix")) if depth else keyed.join(F.broadcast(open_), "draw")
        digit = F.shiftright("bits", 60 - BITS * (depth + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit")
        counted = under.groupBy("draw", digit).agg(*_sums(F.col("v")))
        before = W.partitionBy("draw").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        placed = counted.select("draw", "digit", F.col("n").alias("size"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in _SUMS])
        lefts = spark.createDataFrame([(b, x["left"]) for b, x in state.items()], "draw int, left long")
        # The digit that holds the last labelled row.
        cuts = placed.join(F.broadcast(lefts), "draw").where((F.col("n") < F.col("left")) & (F.col("left") <= F.col("n") + F.col("size"))).collect()
        met = {r["draw"] for r in cuts}
        for r in cuts:
            x = state[r["draw"]]
            x.update(prefix=(x["prefix"] << BITS) | r["digit"], left=x["left"] - r["n"], n=x["n"] + r["n"], s=x["s"] + r["s"], q=x["q"] + r["q"], size=r["size"])
        for b, x in state.items():
            if x["size"] > LAST and b not in met:
                x.update(size=0)  # nothing is labelled
            elif b not in met:
                x["prefix"] = x["prefix"] << BITS  # in order already, at its own depth
                x.setdefault("depth", depth)
        depth += 1
    told = [(b, x["prefix"] >> BITS * (depth - x.get("depth", depth)), x.get("depth", depth), x["left"] if x["size"] else 0, x["n"], x["s"], x["q"]) for b, x in state.items()]
    cut = spark.createDataFrame(told, "draw int, prefix long, depth int, left long, n long, s double, q double")
    last = keyed.join(F.broadcast(cut.where("left > 0").select("draw", "prefix", "depth", "left")), "draw")
    last = last.where(F.expr(f"shiftright(bits, 60 - {BITS} * depth)") == F.col("prefix"))
    last = last.withColumn("r", F.row_number().over(W.partitionBy("draw").orderBy("order", "id", "v"))).where(F.col("r") <= F.col("left"))
    last = last.groupBy("draw").agg(*[c.alias(f"last_{name}") for name, c in zip(_SUMS, (F.count("*"), F.sum("v"), F.sum(F.col("v") * F.col("v"))))])
    ends = [F.col(c) + F.coalesce(f"last_{c}", F.lit(0)) for c in _SUMS]
    dealt = cut.join(F.broadcast(last), "draw", "left").select("draw", _statistic(statistic, *ends, *totals).alias("statistic"))
    seen = spark.range(1).select(F.lit(0).alias("draw"), _statistic(statistic, *[F.lit(whole[f"g{c}"]) for c in _SUMS], *totals).alias("statistic"))
    return seen.unionByName(dealt)


def empirical_p(permuted: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """One row: ``observed`` (draw 0), ``shuffles`` and ``p``, the share of draws as far out, the observed one counted too."""
    seen, drawn = F.max(F.when(F.col("draw") == 0, F.col("statistic"))).alias("observed"), permuted.where("draw > 0")
    out = {"two-sided": F.abs("statistic") >= F.abs("observed"), "greater": F.col("statistic") >= F.col("observed"), "less": F.col("statistic") <= F.col("observed")}[alternative]
    return drawn.crossJoin(F.broadcast(permuted.agg(seen))).agg(F.first("observed").alias("observed"), F.count("statistic").alias("shuffles"), ((F.count_if(out) + 1) / (F.count("statistic") + 1)).alias("p"))


def shuffle_residuals(df: DataFrame, id_col: str, y: str, predicted: str, seed: str = "0") -> DataFrame:
    """``df`` with ``y`` anew: what is predicted plus another row's residual, each dealt once.  Ids should be unique."""
    dealt = shuffled(df.withColumn("__residual", F.col(y) - F.col(predicted)), id_col, ["__residual"], seed)
    return dealt.withColumn(y, F.col(predicted) + F.col("__residual")).select(*df.columns)
