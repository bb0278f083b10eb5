"""Which tables can serve one task: roles from column signatures, and the columns that all evidence shares.

A signature has a row for each column of a table.  Roles are decided by grouped
aggregation over signatures, whatever the number of tables.  The tables
accepted as evidence depend on their order, widest first: each must leave enough
columns in common with those accepted before it.  As the common columns only ever
shrink, the fold carries one list of names, the labelled table's features at
most, over the tables of one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Names of columns that number rows.
ROW_NUMBERS = ("", "index", "unnamed: 0", "unnamed_0", "unnamed", "__index_level_0__")


def plain_name(name: Column) -> Column:
    """A column's name without case, quotes and the punctuation of one export."""
    low = F.lower(F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", ""))
    return F.regexp_replace(F.regexp_replace(low, r"[\s\-.]+", "_"), "[^0-9a-z_]+", "")


def signatures(tables: Mapping[str, DataFrame], categories: int = 50) -> DataFrame:
    """``(table, position, column, plain, kind, n_rows, digest)`` with one aggregation a table.

    A column is ``numeric``, a ``category`` of at most ``categories`` values, ``text``,
    ``empty`` or an ``index``.  The digest covers all rows in any order; tables
    of the same rows have the same.
    """
    out = None
    for name, df in tables.items():
        every = [F.col(f"`{c}`") for c in df.columns]
        told = [F.count("*").alias("n"), F.sum(F.xxhash64(*every).cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), *every)).alias("xor")]
        for i, (c, kind) in enumerate(df.dtypes):
            told.append(F.count(F.col(f"`{c}`")).alias(f"c{i}"))
            if kind not in NUMERIC and not kind.startswith("decimal"):
                told.append(F.count_distinct(F.col(f"`{c}`").cast("string")).alias(f"u{i}"))
        row = df.agg(*told)
        kinds = []
        for i, (c, kind) in enumerate(df.dtypes):
            number = kind in NUMERIC or kind.startswith("decimal")
            filled = F.lit("numeric") if number else F.when(F.col(f"u{i}") <= categories, "category").otherwise("text")
            kinds.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.when(F.lit(c.strip().lower() in ROW_NUMBERS), "index").when(F.col(f"c{i}") == 0, "empty").otherwise(filled).alias("kind")))
        digest = F.concat_ws(":", F.col("n").cast("string"), "sum", F.col("xor").cast("string"))
        part = row.select(F.lit(name).alias("table"), F.inline(F.array(*kinds)), F.col("n").alias("n_rows"), digest.alias("digest")) if kinds else None
        out = part if out is None else out if part is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables with columns")
    return out.withColumn("plain", plain_name(F.col("column")))


def required_shared(n_features: Column, count: int, share: float) -> Column:
    """How many of the features a table must have: ``count`` or the share of them, whichever is more."""
    return F.greatest(F.lit(count), F.ceil(n_features * share).cast("int"))


def assemble_plan(signature: DataFrame, target: str, primary: str | None = None, count: int = 2, share: float = 0.5, pool: bool = False) -> DataFrame:
    """``(table, role, reason, features, shared, n_rows)`` for every table of ``signature``.

    A table with the target column and a usable feature is ``gold``; the primary
    one is the one named, else that of most rows.  Other labelled tables are
    ``gold`` too if ``pool``, else evidence.  ``supplementary`` tables share enough
    features of the primary one, also with one another; a mirror of the primary table
    and what shares too little are ``unusable``.  Without a labelled table every other table of
    use is supplementary and nothing is compared.  ``features`` are the usable columns,
    ``shared`` the plain names in common with the primary table, in its order.
    """
    usable = F.col("kind").isin("numeric", "category") & (F.col("column") != target)
    tables = signature.groupBy("table").agg(
        F.max("n_rows").alias("n_rows"), F.max("digest").alias("digest"), F.count("*").alias("n_columns"), F.max(F.col("column") == target).alias("labelled"),
        F.array_sort(F.collect_list(F.when(usable, F.struct("position", "column", "plain")))).alias("f"),
    )
    names = F.transform("f", lambda x: x["plain"])
    # A plain name that two columns of a table claim serves neither.
    clear = F.filter(names, lambda p: F.size(F.filter(F.col("names"), lambda q: q == p)) == 1)
    tables = tables.withColumn("names", names).withColumn("clear", clear)
    first = tables.where("labelled AND size(f) > 0" if primary is None else F.col("labelled") & (F.size("f") > 0) & (F.col("table") == primary))
    first = first.agg(F.min_by(F.struct("table", "digest", "clear"), F.struct((-F.col("n_rows")).alias("n"), "table")).alias("p"))
    told = tables.crossJoin(F.broadcast(first))
    own = F.col("table") == F.col("p.table")
    shared = F.filter(F.col("p.clear"), lambda p: F.array_contains(F.col("clear"), p))
    told = told.withColumn("shared", F.coalesce(F.when(own, F.col("p.clear")).otherwise(shared), F.array().cast("array<string>")))
    least = F.when(F.col("p.table").isNotNull(), required_shared(F.size(F.col("p.clear")), count, share))
    said = (
        F.when(F.col("n_columns") < 2, "not a table")
        .when(F.size("f") == 0, "no usable feature")
        .when(F.coalesce(own, F.lit(False)), "primary")
        .when(F.col("p.table").isNotNull() & (F.col("digest") == F.col("p.digest")), "mirror of the primary table")
        .when(F.col("labelled") & F.lit(pool), "pooled")
        .when(F.col("p.table").isNotNull() & (F.size("shared") < least), "too few shared features")
        .otherwise("candidate")
    )
    told = told.withColumn("reason", said).withColumn("least", least)
    order = F.array_sort(F.collect_list(F.when(F.col("reason") == "candidate", F.struct((-F.size("shared")).alias("n"), "table", "shared", "least"))))
    start = F.struct(F.lit(None).cast("array<string>").alias("common"), F.array().cast("array<string>").alias("taken"))

    def take(state: Column, t: Column) -> Column:
        left = F.when(state["common"].isNull(), t["shared"]).otherwise(F.filter(state["common"], lambda n: F.array_contains(t["shared"], n)))
        fits = t["least"].isNull() | (F.size(left) >= t["least"])
        return F.when(fits, F.struct(left.alias("common"), F.concat(state["taken"], F.array(t["table"])).alias("taken"))).otherwise(state)

    accepted = told.agg(F.aggregate(order, start, take).alias("e"))
    told = told.crossJoin(F.broadcast(accepted))
    reason = F.when(F.col("reason") != "candidate", F.col("reason")).when(F.array_contains(F.col("e.taken"), F.col("table")), "evidence").otherwise("would narrow the shared features too far")
    told = told.withColumn("reason", reason)
    role = F.when(F.col("reason").isin("primary", "pooled"), "gold").when(F.col("reason") == "evidence", "supplementary").otherwise("unusable")
    return told.select("table", role.alias("role"), "reason", F.transform("f", lambda x: x["column"]).alias("features"), "shared", "n_rows")


def common_features(plan: DataFrame) -> DataFrame:
    """The features that the primary table shares with all evidence, in its order; all of them without evidence."""
    kept = plan.where("reason IN ('primary', 'evidence', 'pooled')").agg(F.max(F.when(F.col("reason") == "primary", F.col("shared"))).alias("own"), F.collect_list(F.when(F.col("reason") != "primary", F.col("shared"))).alias("others"))
    return kept.select(F.posexplode(F.filter("own", lambda n: F.forall(F.col("others"), lambda o: F.array_contains(o, n)))).alias("position", "feature"))


def renamed_to(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A table's columns of the given plain names, under these names."""
    forms: dict[str, list[str]] = {}
    for row in df.sparkSession.createDataFrame([(c,) for c in df.columns], "c string").select("c", plain_name(F.col("c")).alias("p")).collect():
        forms.setdefault(row.p, []).append(row.c)
    missing = [f for f in features if len(forms.get(f, ())) != 1]
    if missing:
        raise ValueError(f"no single column for {missing[:3]}")
    return df.select(*[F.col(f"`{forms[f][0]}`").alias(f) for f in features])


def pooled_rows(tables: Mapping[str, DataFrame], features: Sequence[str]) -> DataFrame:
    """Rows of several tables over common features, with their ``origin``."""
    parts = [renamed_to(df, features).withColumn("origin", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
