"""Feature engineering.

The encoder is fitted with one aggregation pass (means, population standard
deviations, sorted category sets); the fitted parameters are a few numbers and
category lists, so the transform is a single ``select`` of literal-parameterised
expressions -- no join, no UDF, whole-stage codegen.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def scale_expr(c: str, mean: float, std: float) -> Column:
    """(x - mean) / std_pop, std 0 treated as 1."""
    return (_q(c).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)


def ordinal_expr(c: str, order: Sequence[str]) -> Column:
    """position in the given order (0-based); unseen or NULL -> -1."""
    arr = F.array(*[F.lit(v) for v in order])
    return (F.coalesce(F.array_position(arr, _q(c).cast("string")), F.lit(0)) - 1).cast("double")


def one_hot_exprs(c: str, categories: Sequence[str], prefix: str = "ohe__",
                  drop_first: bool = False) -> list[Column]:
    """one indicator per learned category; unseen -> all zeros."""
    cats = list(categories)[1:] if drop_first else list(categories)
    return [F.coalesce((_q(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0))
            .alias(f"{prefix}{c}_{v}") for v in cats]


@dataclass
class FeatureEncoder:
    """``num__`` scaled numerics, ``ord__`` ordinals, ``ohe__`` one-hot columns.

    Columns not named in a role are dropped (remainder = drop).
    """
    numerical: list = field(default_factory=list)
    ordinal: dict = field(default_factory=dict)
    nominal: list = field(default_factory=list)
    drop_first: bool = False
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    max_categories: int | None = None

    def fit(self, df: DataFrame) -> "FeatureEncoder":
        if self.nominal and self.max_categories is not None:
            # one column per category is the caller's choice; with a limit, an id-like
            # column is refused before its categories are collected (HyperLogLog sketch)
            approx = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"a{i}")
                              for i, c in enumerate(self.nominal)]).first()
            wide = [c for i, c in enumerate(self.nominal) if approx[f"a{i}"] > self.max_categories]
            if wide:
                raise ValueError(f"too many categories to one-hot encode: {wide}")
        aggs = []
        for i, c in enumerate(self.numerical):
            x = _q(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        for i, c in enumerate(self.nominal):
            aggs.append(F.array_sort(F.collect_set(_q(c).cast("string"))).alias(f"k{i}"))
        row = df.agg(*aggs).first() if aggs else {}
        self.means = {c: row[f"m{i}"] for i, c in enumerate(self.numerical)}
        self.stds = {c: row[f"s{i}"] for i, c in enumerate(self.numerical)}
        self.categories = {c: list(row[f"k{i}"]) for i, c in enumerate(self.nominal)}
        return self

    def columns(self) -> list[Column]:
        cols = [scale_expr(c, self.means[c], self.stds[c]).alias(f"num__{c}") for c in self.numerical]
        cols += [ordinal_expr(c, order).alias(f"ord__{c}") for c, order in self.ordinal.items()]
        for c in self.nominal:
            cols += one_hot_exprs(c, self.categories[c], drop_first=self.drop_first)
        return cols

    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.numerical] + [f"ord__{c}" for c in self.ordinal]
        for c in self.nominal:
            cats = self.categories[c][1:] if self.drop_first else self.categories[c]
            names += [f"ohe__{c}_{v}" for v in cats]
        return names

    def nominal_features(self) -> list[list[str]]:
        """The one-hot columns of each nominal column."""
        return [[f"ohe__{c}_{v}" for v in (self.categories[c][1:] if self.drop_first else self.categories[c])] for c in self.nominal]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[_q(k) for k in keep], *self.columns())

    # -- persistence (S4) --------------------------------------------------
    def to_json(self) -> str:
        return json.dumps({"numerical": self.numerical, "ordinal": self.ordinal,
                           "nominal": self.nominal, "drop_first": self.drop_first,
                           "means": self.means, "stds": self.stds,
                           "categories": self.categories, "max_categories": self.max_categories})

    @classmethod
    def from_json(cls, text: str) -> "FeatureEncoder":
        return cls(**json.loads(text))


def scaler_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with the population standard deviation."""
    long = df.select(*[_q(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"),
                                       F.stddev_pop("value").alias("std"))


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) distinct categories, to be read in sorted order."""
    long = df.select(*[_q(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    return long.where(F.col("value").isNotNull()).select("feature", "value").distinct()


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
            keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """dummies fitted on the whole table (``get_dummies``), other columns kept."""
    enc = FeatureEncoder(nominal=list(cols), drop_first=drop_first).fit(df)
    keep = [c for c in df.columns if c not in cols] if keep is None else list(keep)
    exprs = []
    for c in cols:
        exprs += one_hot_exprs(c, enc.categories[c], prefix=prefix, drop_first=drop_first)
    return df.select(*[_q(k) for k in keep], *exprs)


#: Classes that are sent to every task; more than these are joined by class and salt.
BROADCAST_CLASSES = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, left: str, right: str, spread: Sequence[str] | str, how: str = "left",
                 null_safe: bool = False) -> DataFrame:
    """``rows`` joined by ``left`` = ``right`` with ``classes``, one row per class value.

    A plain join by a class shuffles all rows of a class to one task.  So few classes are collected
    and broadcast; many are repeated per salt, and a row's salt is a hash of the columns ``spread``."""
    spark = rows.sparkSession
    few = classes.limit(BROADCAST_CLASSES + 1).toArrow()
    same = F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right)
    if few.num_rows <= BROADCAST_CLASSES:
        return rows.join(F.broadcast(spark.createDataFrame(few, classes.schema)), same, how)
    salts = shuffle_partitions(spark)
    spread = [spread] if isinstance(spread, str) else list(spread)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[_q(c) for c in spread]), F.lit(salts)))
    each = classes.withColumn("__salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(each, same & (F.col("__salt") == F.col("__salted")), how).drop("__salt", "__salted")


def split_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of '<seed>:<id>'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _q(id_col).cast("string")))


def split_cuts(df: DataFrame, target: str | None, id_col: str, seed: int, test_size: float,
               val_size: float) -> DataFrame:
    """Per class (``__c``) the last (key, id) of the test rows and of the validation rows.

    Rows are counted per class and first four digits of the key (at most 65,536 buckets a
    class); only the buckets that hold a quota's boundary are ranked."""
    ratio = val_size / (1.0 - test_size)
    cls = _q(target) if target else F.lit(0)
    keyed = df.select(cls.alias("__c"), split_key(id_col, seed).alias("__key"), _q(id_col).alias("__id"))
    keyed = keyed.withColumn("__b", F.substring("__key", 1, 4))
    counts = keyed.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("__n"))
    per_class = Window.partitionBy("__c")
    up_to = per_class.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("__c", "__b", "__n", F.sum("__n").over(up_to).alias("__hi"), F.sum("__n").over(per_class).alias("__all"))
    n_test = F.floor(F.col("__all") * F.lit(test_size) + F.lit(0.5))
    n_val = F.floor((F.col("__all") - n_test) * F.lit(ratio) + F.lit(0.5))
    cuts = counts.select("*", F.inline(F.array(F.struct(F.lit("test").alias("__name"), n_test.alias("__at")),
                                               F.struct(F.lit("val").alias("__name"), (n_test + n_val).alias("__at")))))
    low = F.col("__hi") - F.col("__n")
    cuts = cuts.where((low < F.col("__at")) & (F.col("__at") <= F.col("__hi"))).select(
        F.col("__c").alias("__cc"), F.col("__b").alias("__cb"), "__name", (F.col("__at") - low).alias("__k"))
    inside = keyed.join(cuts, F.col("__c").eqNullSafe(F.col("__cc")) & (F.col("__b") == F.col("__cb")))
    place = F.row_number().over(Window.partitionBy("__c", "__b", "__name").orderBy("__key", "__id"))
    edge = F.struct("__key", "__id")
    found = inside.withColumn("__r", place).where(F.col("__r") == F.col("__k"))
    last = [F.max(F.when(F.col("__name") == name, edge)).alias(f"__{name}") for name in ("test", "val")]
    return found.groupBy("__c").agg(*last)


def stratified_split(df: DataFrame, target: str, id_col: str, seed: int = 42,
                     test_size: float = 0.2, val_size: float = 0.1,
                     split_col: str = "split", stratify: bool = True) -> DataFrame:
    """exact per-class quotas -- test first, then validation from the rest.

    n_test = round(n_c * test_size), n_val = round((n_c - n_test) * val_size /
    (1 - test_size)), half up.  Rows are ordered inside their class by md5(seed:id) and cut
    at the quotas; the split is a comparison with the class's cut keys (:func:`split_cuts`),
    so nothing is ranked as a whole or written, and filters reach the scan.
    ``stratify=False`` takes the quotas of the whole table.
    """
    cuts = split_cuts(df, target if stratify else None, id_col, seed, test_size, val_size)
    cls = _q(target) if stratify else F.lit(0)
    keyed = df.withColumn("__row", F.struct(split_key(id_col, seed).alias("__key"), _q(id_col).alias("__id"))).withColumn("__cls", cls)
    out = join_classes(keyed, cuts, "__cls", "__c", spread="__row", null_safe=True)
    return out.select(
        *[_q(c) for c in df.columns],
        F.when(F.col("__row") <= F.col("__test"), "test")
         .when(F.col("__row") <= F.col("__val"), "val")
         .otherwise("train").alias(split_col))


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """F8: class weight n / (k * n_c) per class value."""
    counts = df.groupBy(target).agg(F.count("*").alias("n_c"))
    from .profiling import scalar
    n = scalar(df, F.count("*"))
    k = scalar(df, F.count_distinct(_q(target)))
    return counts.select(target, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, target: str, weight_col: str = "weight") -> DataFrame:
    """Attach balanced class weights (one row per class)."""
    w = balanced_weights(df, target).select(_q(target).alias("__c"), F.col("weight").alias(weight_col))
    out = join_classes(df, w, target, "__c", spread=[c for c in df.columns if c != target] or target, how="inner")
    return out.select(_q(target), *[_q(c) for c in df.columns if c != target], weight_col)


def positive_weight(target: str, weight: float = 8.0) -> Column:
    """fixed weight for the positive class."""
    return F.when(_q(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))


def build_features(df: DataFrame, settings, id_col: str, out_path: str | None = None,
                   smote: bool | None = None):
    """clean -> stratified split -> encoder fitted on train only -> encoded
    table with ``split`` (-> SMOTE on the train rows) (-> Parquet partitioned by
    split).  Returns (encoder, encoded DataFrame)."""
    from .cleaning import clean

    cleaned = clean(df, settings)
    split = stratified_split(cleaned, settings.target, id_col, settings.seed,
                             settings.test_size, settings.val_size, stratify=settings.stratify)
    nominal = [c for c in settings.categorical if c not in settings.ordinal]
    enc = FeatureEncoder(numerical=list(settings.numerical), ordinal=dict(settings.ordinal),
                         nominal=nominal).fit(split.where(F.col("split") == "train"))
    encoded = enc.transform(split, keep=[id_col, "split", settings.target])
    use_smote = settings.smote_enabled if smote is None else smote
    if use_smote:
        from ..session import materialize
        from .smote import smote as smote_op

        # read by the neighbour search and by the result: written once
        encoded = materialize(encoded, "encoded")
        train = encoded.where(F.col("split") == "train")
        rest = encoded.where(F.col("split") != "train")
        balanced = smote_op(train, enc.feature_names(), settings.target, id_col,
                            k=settings.smote_k, seed=settings.seed, nominal=enc.nominal_features())
        encoded = balanced.unionByName(rest, allowMissingColumns=True)
    if out_path:
        from ..sources.files import write_splits

        write_splits(encoded, out_path)
    return enc, encoded
