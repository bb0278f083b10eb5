"""Perturbation screens: what was perturbed, controls, splits by identity, and how predicted responses compare.

Cells and responses are long tables, ``(sample, gene, value)`` and ``(label, gene,
value)``; cells that are not stored are zero.  Labels are parsed by column
expressions.  Splits draw identities, not cells, and rows follow their identity
by a join.  Responses are ranked within a label, whose rows are one panel of genes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.cleaning import present
from spectrafold.operators.inference import spearman
from spectrafold.operators.statistics import numbered, quantiles

# What separates the genes of a condition (the first that occurs counts), the labels of controls, and control guides.
SEPARATORS = ("+", "_", ";")
CONTROLS = ("ctrl", "control", "control_ctrl", "vehicle", "none", "non-targeting", "non_targeting", "nt", "wt", "unperturbed")
CONTROL_GUIDES = ("egfp", "gfp", "lacz", "scramble", "safeharbor")
PLACEHOLDER = "ctrl"
# The least columns, share of zeros and share of whole numbers of a count matrix.
LEAST_COLUMNS, LEAST_ZEROS, LEAST_WHOLE = 500, 0.5, 0.99


def condition_genes(condition: Column, separators: Sequence[str] = SEPARATORS) -> Column:
    """Genes of a condition: ``CBL+CNN1`` has two, an empty or null one none.  A placeholder beside a gene is dropped."""
    text = F.trim(F.coalesce(condition.cast("string"), F.lit("")))
    out = F.array(text)
    for s in reversed(separators):
        parts = F.filter(F.split(text, f"\\Q{s}\\E"), lambda p: p != "")
        genes = F.filter(parts, lambda p: F.lower(p) != PLACEHOLDER)
        out = F.when(F.contains(text, F.lit(s)), F.when(F.size(genes) > 0, genes).otherwise(parts)).otherwise(out)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(out)


def is_control(condition: Column, labels: Sequence[str] = CONTROLS, guides: Sequence[str] = CONTROL_GUIDES) -> Column:
    """Whether nothing was perturbed: a control label, one with a guide's number, or a control guide with its number."""
    text = F.lower(F.trim(F.coalesce(condition.cast("string"), F.lit(""))))
    named = [f"\\Q{x.lower()}\\E" for x in [*(x for x in labels if len(x) >= 2), *guides]]
    return text.isin([x.lower() for x in labels]) | F.rlike(text, F.lit(f"^({'|'.join(named)})[a-z]?[0-9]+$"))


def perturbed_genes(tokens: DataFrame, token: str, known: DataFrame, gene: str) -> DataFrame:
    """``tokens`` with ``perturbed``: the gene of a guide such as ``ATF2g1`` if ``known`` has it and not the token itself, else the token."""
    text = F.trim(F.col(token).cast("string"))
    stem = F.regexp_extract(text, r"(?i)^(.+?)[-_.]?g[0-9]+$", 1)
    names = known.select(F.col(gene).cast("string").alias("__known")).where("__known IS NOT NULL").distinct()
    told = tokens.withColumns({"__text": text, "__stem": stem})
    own = told.join(names.withColumn("__own", F.lit(True)), F.col("__text") == F.col("__known"), "left").drop("__known")
    both = own.join(names.withColumn("__cut", F.lit(True)), (F.col("__stem") == F.col("__known")) & (F.col("__stem") != ""), "left").drop("__known")
    chosen = F.when(F.col("__own").isNull() & F.col("__cut"), F.col("__stem")).otherwise(F.col("__text"))
    return both.withColumn("perturbed", chosen).drop("__text", "__stem", "__own", "__cut")


def control_pools(df: DataFrame, condition: str, context: Sequence[str] = ()) -> DataFrame:
    """Control rows with the ``pool`` each belongs to: ``global``, and the values of the context joined by ``|`` if there are any."""
    pools = [F.lit("global")]
    if context:
        pools.append(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in context]))
    return df.where(is_control(F.col(condition))).withColumn("pool", F.explode(F.array(*pools)))


def identity_split(df: DataFrame, condition: str, mode: str = "mixed", test: float = 0.2, validation: float = 0.1, seed: str = "42", holdout: Sequence[str] = ()) -> DataFrame:
    """``(condition, split)`` of every distinct condition that perturbs something.

    Conditions of one gene and of several are drawn apart, in the order of a
    hash of seed and name: of those that the mode holds out (``unseen_single``,
    ``unseen_combination`` or both, ``mixed``) the rounded share is ``test``, and of the
    rest the rounded share ``validation``.  Conditions in ``holdout`` are ``test``.  If no
    condition is left for validation, the last for training by hash is moved, if two are there.
    """
    if mode not in ("unseen_single", "unseen_combination", "mixed"):
        raise ValueError(f"unknown split mode {mode!r}")
    text = F.trim(F.col(condition).cast("string"))
    names = df.where(F.col(condition).isNotNull() & ~is_control(F.col(condition))).select(text.alias("condition")).where("condition <> ''").distinct()
    names = names.withColumn("pool", F.when(F.col("condition").isin([str(h) for h in holdout]), "forced").when(F.size(condition_genes(F.col("condition"))) > 1, "several").otherwise("one"))
    placed = numbered(names.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("condition")))), ["pool", "h", "condition"], "at")
    sizes = placed.groupBy("pool").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    drawn = {"unseen_single": ["one"], "unseen_combination": ["several"], "mixed": ["one", "several"]}[mode]
    n_test = F.when(F.col("pool").isin(drawn), F.bround(F.col("n") * test).cast("long")).otherwise(0)
    n_validation = F.when(F.col("pool").isin(drawn), F.bround((F.col("n") - n_test) * validation).cast("long")).otherwise(0)
    told = placed.join(F.broadcast(sizes.select("pool", "first", n_test.alias("t"), n_validation.alias("v"))), "pool")
    k = F.col("at") - F.col("first")
    split = F.when((F.col("pool") == "forced") | (k < F.col("t")), "test").when(k < F.col("t") + F.col("v"), "validation").otherwise("train")
    told = told.select("condition", "h", split.alias("split"))
    counts = told.agg(F.count_if(F.col("split") == "validation").alias("v"), F.count_if(F.col("split") == "train").alias("n"), F.max(F.when(F.col("split") == "train", F.struct("h", "condition"))).alias("last"))
    moved = (F.col("v") == 0) & (F.col("n") >= 2) & (F.struct("h", "condition") == F.col("last"))
    return told.crossJoin(F.broadcast(counts)).select("condition", F.when(moved, "validation").otherwise(F.col("split")).alias("split"))


def route(df: DataFrame, condition: str, splits: DataFrame) -> DataFrame:
    """Rows with the ``split`` of their condition; controls and rows without one are left out."""
    named = splits.select(F.col("condition").alias("__c"), "split")
    return df.join(named, F.trim(F.col(condition).cast("string")) == F.col("__c")).drop("__c")


def count_matrix_verdict(cells: DataFrame, n_samples: int, n_genes: int, single_cell: bool = False) -> DataFrame:
    """``(is_counts, reason, zeros, whole, least)`` of a matrix of which ``cells(value)`` are stored.

    A count matrix is wide, never negative, mostly zero and of whole numbers; one
    that comes from a single-cell file need only be wide and not negative.  Null and infinite values are left out.
    """
    v = present("value").cast("double")
    total = n_samples * n_genes
    m = cells.select(F.when(F.abs(v) < float("inf"), v).alias("v")).agg(F.count("v").alias("stored"), F.count("*").alias("all"), F.min("v").alias("low"), F.count_if(F.col("v") == 0).alias("zero"), F.count_if(F.col("v") == F.floor("v")).alias("whole"))
    empty = F.lit(total) - F.col("all")
    known = F.col("stored") + empty
    m = m.select("stored", F.try_divide(F.col("zero") + empty, known).alias("zeros"), F.try_divide(F.col("whole") + empty, known).alias("whole"), F.when(empty > 0, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("least"))
    reason = (
        F.when(F.lit(n_genes < LEAST_COLUMNS), "too few columns")
        .when(F.col("zeros").isNull(), "every value is missing")
        .when(F.col("least") < 0, "negative values")
        .when(F.lit(single_cell), "single-cell file")
        .when(F.col("zeros") < LEAST_ZEROS, "too few zeros")
        .when(F.col("whole") < LEAST_WHOLE, "not whole numbers")
        .otherwise("counts")
    )
    return m.select(reason.isin("counts", "single-cell file").alias("is_counts"), reason.alias("reason"), "zeros", "whole", "least")


def called_cells(cells: DataFrame, least: float) -> DataFrame:
    """``cells(sample, gene, value)`` of the samples whose values add up to at least ``least``."""
    some = cells.groupBy("sample").agg(F.sum("value").alias("__total")).where(F.col("__total") >= least).select("sample")
    return cells.join(some, "sample", "left_semi")


def mean_log_cpm(cells: DataFrame, n_samples: int, target: float = 1e4) -> DataFrame:
    """``(gene, mean)`` of log(1 + value / total of its sample * target) over all samples, zeros included."""
    summed = cells.where("sample IS NOT NULL AND gene IS NOT NULL").groupBy("sample", "gene").agg(F.sum("value").alias("value"))
    totals = summed.groupBy("sample").agg(F.sum("value").alias("__total"))
    scaled = summed.join(totals, "sample").select("gene", F.log1p(F.col("value") / F.when(F.col("__total") > 0, F.col("__total")).otherwise(1.0) * target).alias("x"))
    return scaled.groupBy("gene").agg((F.sum("x") / n_samples).alias("mean"))


def profile_similarity(reference: DataFrame, cells: DataFrame, n_samples: int, target: float = 1e4, least: float = 0.1) -> DataFrame:
    """How alike a sample is to a reference profile ``(gene, mean)``, over genes that both have and the reference expresses.

    One row: shared_genes, pearson and spearman (null below three genes), and the medians over
    samples of their total, their number of genes and their share of ribosomal genes.
    """
    both = reference.select("gene", F.col("mean").alias("a")).where(F.col("a") > least).join(mean_log_cpm(cells, n_samples, target).select("gene", F.col("mean").alias("b")), "gene")
    flat = both.agg(F.count("*").alias("shared_genes"), F.corr("a", "b").alias("r"))
    rank = spearman(both, "a", "b").select(F.max("r").alias("s"))
    summed = cells.where("value <> 0").groupBy("sample", "gene").agg(F.sum("value").alias("value"))
    ribosomal = F.when(F.rlike(F.col("gene").cast("string"), F.lit(r"^RP[SL]\d")), F.col("value")).otherwise(0.0)
    each = summed.groupBy("sample").agg(F.sum("value").alias("t"), F.count("*").cast("double").alias("g"), F.sum(ribosomal).alias("r"))
    each = each.withColumn("r", F.col("r") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))
    middle = [quantiles(each, c, [0.5]).select(F.col("q0").alias(n)) for c, n in (("t", "median_total"), ("g", "median_genes"), ("r", "ribosomal_share"))]
    out = flat.crossJoin(F.broadcast(rank))
    for m in middle:
        out = out.crossJoin(F.broadcast(m))
    some = F.col("shared_genes") > 2
    return out.select("shared_genes", F.when(some, F.col("r")).alias("pearson"), F.when(some, F.col("s")).alias("spearman"), "median_total", "median_genes", "ribosomal_share")


def moved_genes(responses: DataFrame, top: int | None = None, threshold: float | None = None) -> DataFrame:
    """``responses(label, gene, value)`` of the genes that moved: the ``top`` by size (ties to the lesser gene), or those of at least
    the threshold where a label has any, else all that are not zero."""
    size = F.abs("value")
    if top is not None:
        return responses.withColumn("__k", F.row_number().over(W.partitionBy("label").orderBy(F.desc(size), "gene"))).where(F.col("__k") <= max(1, top)).drop("__k")
    if threshold is None:
        return responses.where(size > 0)
    most = F.max(size).over(W.partitionBy("label"))
    return responses.withColumn("__m", most).where(F.when(F.col("__m") >= threshold, size >= threshold).otherwise(size > 0)).drop("__m")


def retained_genes(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, gene)`` of the genes whose mean over the label's samples is not zero, from ``cells(sample, gene, value)`` and ``labels(sample, label)``."""
    return cells.join(labels, "sample").groupBy("label", "gene").agg(F.sum("value").alias("total")).where("total <> 0").select("label", "gene")


def response_metrics(predicted: DataFrame, observed: DataFrame, top: int = 20) -> DataFrame:
    """Per label that both ``(label, gene, value)`` tables have: errors, correlations and agreement on the genes that moved.

    ``_deg`` is over the ``top`` genes by observed size, ``pearson_specific`` over what
    differs from the mean of all labels, null with one label.  Correlations of constant values are null.  Genes of
    one table only count as zero in the other.
    """
    p, o = (t.select("label", "gene", F.col("value").cast("double").alias(n)) for t, n in ((predicted, "p"), (observed, "o")))
    labels = p.select("label").distinct().join(o.select("label").distinct(), "label")
    both = p.join(o, ["label", "gene"], "full_outer").join(labels, "label", "left_semi").fillna(0.0, ["p", "o"])
    n_labels = labels.agg(F.count("*").alias("n_labels"))
    means = both.groupBy("gene").agg(F.sum("p").alias("pm"), F.sum("o").alias("om"))
    rows = both.join(means, "gene").crossJoin(F.broadcast(n_labels)).withColumns({"pm": F.col("pm") / F.col("n_labels"), "om": F.col("om") / F.col("n_labels")})
    by = W.partitionBy("label")
    place = lambda c: F.row_number().over(by.orderBy(F.desc(F.abs(c)), "gene"))
    mid = lambda c: F.rank().over(by.orderBy(c)) + (F.count("*").over(W.partitionBy("label", c)) - 1) / 2
    rows = rows.withColumns({"deg": place("o") <= top, "mine": place("p") <= top, "rp": mid("p"), "ro": mid("o")})
    deg = lambda c: F.when(F.col("deg"), c)
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    gap = (F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))
    return rows.groupBy("label").agg(
        F.avg(gap).alias("mse"), F.avg(deg(gap)).alias("mse_deg"), r("p", "o").alias("pearson"), r(deg(F.col("p")), deg(F.col("o"))).alias("pearson_deg"),
        F.when(F.max("n_labels") > 1, r(F.col("p") - F.col("pm"), F.col("o") - F.col("om"))).alias("pearson_specific"), r("rp", "ro").alias("spearman"),
        F.avg(deg((F.signum("p") == F.signum("o")).cast("double"))).alias("direction_accuracy"), (F.count_if(F.col("deg") & F.col("mine")) / F.count_if("deg")).alias("top_overlap"), F.count_if("deg").alias("n_deg"),
    )


def reference_responses(observed: DataFrame) -> DataFrame:
    """``(reference, label, gene, value)`` for the rows of ``observed``: no response at all, and the mean response of all other labels (zero if there are none)."""
    o = observed.select("label", "gene", F.col("value").cast("double").alias("value"))
    others = o.select("label").distinct().agg((F.count("*") - 1).alias("others"))
    sums = o.groupBy("gene").agg(F.sum("value").alias("total"))
    rest = o.join(sums, "gene").crossJoin(F.broadcast(others)).select("label", "gene", F.coalesce(F.try_divide(F.col("total") - F.col("value"), "others"), F.lit(0.0)).alias("value"))
    return o.select(F.lit("no change").alias("reference"), "label", "gene", F.lit(0.0).alias("value")).unionByName(rest.select(F.lit("mean of the others").alias("reference"), "label", "gene", "value"))


def response_signal(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """How much of the observed variation between labels the predictions have: the mean over genes of the spread across labels, of each, and their ratio; zeros with fewer than two labels."""
    p, o = (t.select("label", "gene", F.col("value").cast("double").alias(n)) for t, n in ((predicted, "p"), (observed, "o")))
    labels = p.select("label").distinct().join(o.select("label").distinct(), "label")
    n = F.broadcast(labels.agg(F.count("*").alias("n")))
    both = p.join(o, ["label", "gene"], "full_outer").join(labels, "label", "left_semi").fillna(0.0, ["p", "o"]).crossJoin(n)
    # Labels without the gene have zero there.
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), (F.var_pop(c) * F.count("*") + F.avg(c) * F.avg(c) * F.count("*") * (F.max("n") - F.count("*")) / F.max("n")) / F.max("n")))
    genes = both.groupBy("gene").agg(spread("p").alias("p"), spread("o").alias("o"))
    out = genes.agg(F.avg("p").alias("across"), F.avg("o").alias("observed_across")).crossJoin(n)
    some = F.col("n") >= 2
    return out.select(F.when(some, F.col("across")).otherwise(0.0).alias("across"), F.when(some, F.col("observed_across")).otherwise(0.0).alias("observed_across"), F.when(some & (F.col("observed_across") > 0), F.col("across") / F.col("observed_across")).otherwise(0.0).alias("signal"))
