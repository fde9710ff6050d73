"""Feature preparation fitted on a training table.

* numeric: missing -> exact training median, then (x - mean) / population std
  (a zero std scales by 1);
* categorical: missing -> training mode (ties -> smallest), then one column
  per training category in alphabetical order; an unseen category encodes as
  all zeros.

The statistics are computed by distributed aggregates: the exact median is
selected by brackets (no sort, no shuffle of values).  The fitted statistics are
written into a ``SQLTransformer`` statement, so the preparation is an
ordinary, saveable ML ``PipelineModel`` stage followed by ``StringIndexer``,
``OneHotEncoder`` and ``VectorAssembler``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = "features"


def _num(c: str):
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def _long(df: DataFrame, cols: list[str], value) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("value").isNotNull())


#: Values of a feature that are fetched and sorted at the end of the median search, at most.
FETCHED = 10_000


@dataclass
class _Search:
    """Where the middle values (by rank, from 0) of one feature can still lie."""

    ranks: tuple[int, int]
    low: float | None = None     # open interval (no end: None), with the number of values at or below its lower end
    high: float | None = None
    below: int = 0
    inside: int = 0
    found: dict = field(default_factory=dict)

    def open_ranks(self) -> list[int]:
        return [k for k in self.ranks if k not in self.found]

    def narrow(self, lo: float, hi: float, counts: list[int]) -> None:
        """Take the counts of values in (low, lo), at lo, in (lo, hi), at hi and in (hi, high)."""
        edges = [(self.low, lo), (lo, lo), (lo, hi), (hi, hi), (hi, self.high)]
        places, upto = [], self.below
        for (start, end), n in zip(edges, counts, strict=True):
            places += [(start, end, upto, n, k) for k in self.open_ranks() if upto <= k < upto + n]
            upto += n
        for start, end, _, _, k in places:
            if start is not None and start == end:
                self.found[k] = start
        rest = [p for p in places if p[0] is None or p[0] != p[1]]
        if rest:
            self.low, self.below = rest[0][0], rest[0][2]
            self.high = rest[-1][1]
            self.inside = rest[-1][2] + rest[-1][3] - self.below


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median) with the two middle values averaged for even counts.

    Selection by bracket: approximate percentiles close to the middle bracket
    it, one aggregate counts the values around and at the ends of the bracket, and
    the search goes on inside it until at most ``FETCHED`` values are left, which
    are fetched and sorted.  Values that repeat often become ends of a bracket and
    are settled by their count, so every pass shrinks the interval.  All features
    share the passes; nothing is shuffled but one row per task.
    """
    value = {c: _num(c) for c in cols}
    counts = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else {}
    searches: dict[str, _Search] = {}
    for i, c in enumerate(cols):
        n = counts[f"n{i}"]
        if n:
            searches[c] = _Search(((n - 1) // 2, n // 2), inside=n)

    def within(c: str):
        s = searches[c]
        fits = F.lit(True) if s.low is None else value[c] > s.low
        return F.when(fits if s.high is None else fits & (value[c] < s.high), value[c])

    while True:
        wide = [c for c, s in searches.items() if s.open_ranks() and s.inside > FETCHED]
        if not wide:
            break
        near = []
        for i, c in enumerate(wide):
            s = searches[c]
            at = [(k - s.below + 0.5) / s.inside for k in s.ranks]
            shares = [max(min(at) - 2e-4, 0.0), min(max(at) + 2e-4, 1.0)]
            near.append(F.percentile_approx(within(c), shares, 10_000).alias(f"b{i}"))
        brackets = df.agg(*near).first()
        around = []
        for i, c in enumerate(wide):
            v, (lo, hi) = within(c), brackets[f"b{i}"]
            parts = [v < lo, v == lo, (v > lo) & (v < hi), (v == hi) & F.lit(hi != lo), v > hi]
            around += [F.count_if(p).alias(f"c{i}_{j}") for j, p in enumerate(parts)]
        found = df.agg(*around).first()
        for i, c in enumerate(wide):
            searches[c].narrow(*brackets[f"b{i}"], [found[f"c{i}_{j}"] for j in range(5)])
    last = [c for c, s in searches.items() if s.open_ranks()]
    if last:
        held = df.agg(*[F.sort_array(F.collect_list(within(c))).alias(f"v{i}") for i, c in enumerate(last)]).first()
        for i, c in enumerate(last):
            s = searches[c]
            s.found |= {k: held[f"v{i}"][k - s.below] for k in s.open_ranks()}
    rows = [(c, (s.found[s.ranks[0]] + s.found[s.ranks[1]]) / 2.0) for c, s in searches.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, median double")


def numeric_moments(df: DataFrame, cols: list[str], medians: dict[str, float]) -> DataFrame:
    """(feature, mean, scale) of median-imputed values; scale = population std or 1."""
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, mean double, scale double")
    aggs = []
    for c in cols:
        v = F.coalesce(_num(c), F.lit(_lit_or_zero(medians.get(c))))
        aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_pop(v).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.when(F.coalesce(F.col(f"{c}__std"), F.lit(0.0)) == 0, F.lit(1.0))
                               .otherwise(F.col(f"{c}__std")).alias("scale")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def categorical_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mode): most frequent non-null value, ties -> smallest."""
    counts = (_long(df, cols, lambda c: F.col(c).cast("string"))
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))


def _lit_or_zero(x) -> float:
    return 0.0 if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def _sql_double(x: float) -> str:
    return f"CAST('{repr(float(x))}' AS DOUBLE)"


def _sql_str(s: str) -> str:
    return "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class PrepStats:
    """Fitted statistics (one value per feature: model state, bounded by the schema)."""

    num_cols: tuple
    cat_cols: tuple
    medians: dict
    means: dict
    scales: dict
    modes: dict

    def sql(self) -> str:
        parts = []
        for c in self.num_cols:
            med, mean, scale = (_lit_or_zero(self.medians.get(c)), self.means.get(c) or 0.0,
                                self.scales.get(c) or 1.0)
            v = f"CAST(`{c}` AS DOUBLE)"
            parts.append(f"(coalesce(CASE WHEN isnan({v}) THEN NULL ELSE {v} END, {_sql_double(med)}) - "
                         f"{_sql_double(mean)}) / {_sql_double(scale)} AS `__num_{c}`")
        for c in self.cat_cols:
            mode = self.modes.get(c)
            fill = _sql_str(mode) if mode is not None else "''"
            parts.append(f"coalesce(CAST(`{c}` AS STRING), {fill}) AS `__cat_{c}`")
        return "SELECT *, " + ", ".join(parts) + " FROM __THIS__" if parts else "SELECT * FROM __THIS__"


def fit_stats(train: DataFrame, num_cols: list[str], cat_cols: list[str]) -> PrepStats:
    medians = {r["feature"]: r["median"] for r in exact_medians(train, num_cols).collect()} if num_cols else {}
    mom = numeric_moments(train, num_cols, medians).collect()
    modes = {r["feature"]: r["mode"] for r in categorical_modes(train, cat_cols).collect()} if cat_cols else {}
    return PrepStats(tuple(num_cols), tuple(cat_cols), medians,
                     {r["feature"]: r["mean"] for r in mom}, {r["feature"]: r["scale"] for r in mom}, modes)


def feature_stages(stats: PrepStats) -> list:
    stages = [SQLTransformer(statement=stats.sql())]
    cats = list(stats.cat_cols)
    if cats:
        stages.append(StringIndexer(inputCols=[f"__cat_{c}" for c in cats], outputCols=[f"__idx_{c}" for c in cats],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"__idx_{c}" for c in cats], outputCols=[f"__ohe_{c}" for c in cats],
                                    dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"__num_{c}" for c in stats.num_cols] + [f"__ohe_{c}" for c in cats],
                                  outputCol=FEATURES, handleInvalid="keep"))
    return stages


def fit_preprocessor(train: DataFrame, num_cols: list[str], cat_cols: list[str]) -> PipelineModel:
    """Numeric block then one-hot block, assembled into ``features``."""
    stats = fit_stats(train, num_cols, cat_cols)
    return Pipeline(stages=feature_stages(stats)).fit(train)


def one_hot_index(df: DataFrame, cat: str) -> DataFrame:
    """Position of the hot bit of ``__ohe_<cat>`` (null for an unseen category)."""
    from pyspark.ml.functions import vector_to_array
    pos = F.array_position(vector_to_array(F.col(f"__ohe_{cat}")), F.lit(1.0))
    return df.withColumn(f"{cat}_hot_index", F.when(pos > 0, pos - 1).cast("int"))


# --------------------------------------------------------------------- split
#: Bits of the ranking hash, bits that one pass looks at, and rows of a class that are ranked at the end, at most.
HASH_BITS, PASS_BITS, RANKED = 60, 10, 50_000


def split_hash(seed: int, id_col: str):
    """60 bits of the md5 of the seed and the id: the same number in every engine."""
    text = F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _quotas(sizes: dict, test_size: float) -> dict:
    """Training rows of each class: largest remainders of its share of n_train, ties in class order."""
    n = sum(sizes.values())
    if min(sizes.values()) < 2:
        raise ValueError("a class with a single row cannot be in both parts of the split")
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    if min(n_test, n_train) < len(sizes):
        raise ValueError(f"{len(sizes)} classes do not fit into parts of {n_train} and {n_test} rows")
    exact = {c: m / n * n_train for c, m in sizes.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    lacking = n_train - sum(quota.values())
    for c in sorted(exact, key=lambda c: (quota[c] - exact[c], c))[:lacking]:
        quota[c] += 1
    return quota


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` ('train' / 'test') keeping class shares exactly.

    Test size is ceil(test_size x n); train quotas per class are the largest
    remainders of (n_class / n) x n_train (ties -> class order).  A row's rank
    is its (seeded hash of the id, id); the last training row of each class is
    found by radix selection: counts per (class, leading hash bits) name the
    bucket where the quota ends, only that bucket is counted again by its next
    bits, and ranked once it holds at most ``RANKED`` rows.  The driver holds 1,024
    counts and one last row for each class, which a classifier lists anyway.
    """
    spark = df.sparkSession
    h = split_hash(seed, id_col)
    keys = df.select(F.col(label).cast("string").alias("__c"), h.alias("__h"), F.col(id_col).alias("__id")).filter("__c is not null")
    buckets = lambda rows, shift: rows.groupBy("__c", F.shiftright("__h", shift).alias("__b")).count().collect()

    def table(rows: dict, columns: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, *r) for c, r in rows.items()], "__c string, " + columns))

    shift = HASH_BITS - PASS_BITS
    counted = buckets(keys, shift)
    sizes: dict = {}
    for r in counted:
        sizes[r["__c"]] = sizes.get(r["__c"], 0) + r["count"]
    if not sizes:
        return df.withColumn("split", F.lit(None).cast("string"))
    take = {c: q for c, q in _quotas(sizes, test_size).items() if q}   # rank of the last row inside the bucket
    while True:
        at: dict = {}
        of_class: dict = {}
        for r in counted:
            of_class.setdefault(r["__c"], []).append((r["__b"], r["count"]))
        for c in take:
            for b, n in sorted(of_class[c]):
                if take[c] <= n:
                    at[c] = (b, n)
                    break
                take[c] -= n
        inside = keys.join(table({c: (b,) for c, (b, _) in at.items()}, "__at long"), "__c").filter(F.shiftright("__h", shift) == F.col("__at"))
        if shift == 0 or max(n for _, n in at.values()) <= RANKED:
            break
        shift -= PASS_BITS
        counted = buckets(inside.drop("__at"), shift)
    order = Window.partitionBy("__c").orderBy("__h", "__id")
    ranked = inside.withColumn("__r", F.row_number().over(order)).join(table({c: (t,) for c, t in take.items()}, "__take long"), "__c")
    last = {r["__c"]: (r["__h"], r["__id"]) for r in ranked.filter("__r = __take").select("__c", "__h", "__id").collect()}
    ends = table(last, f"__lh long, __lid {df.schema[id_col].dataType.simpleString()}")
    rows = df.withColumns({"__c": F.col(label).cast("string"), "__h": h}).join(ends, "__c", "left")
    first = (F.col("__h") < F.col("__lh")) | ((F.col("__h") == F.col("__lh")) & (F.col(id_col) <= F.col("__lid")))
    part = F.when(F.col("__c").isNotNull(), F.when(first, F.lit("train")).otherwise(F.lit("test")))
    return rows.select(*df.columns, part.alias("split"))
