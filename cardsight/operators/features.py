"""Feature building (M1) with its fitted pieces (A15-A17, J1-J3, X1-X16,
P1, P2, P6, P7).

``fit_features`` computes small fitted tables and scalars -- per-merchant
encodings, per-state rates and the levels of the text columns stay DataFrames;
medians, means, deviations and modes are a few values each. ``transform`` is then
column expressions plus lookup joins: no Python UDF. A row's features are one sparse
vector: a level takes no column, and no list of levels reaches the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardsight.constants import HIGH_CARD_COLS, SAMPLER_DROP_COLS, TE_MIN_SAMPLES_LEAF, TE_SMOOTHING
from cardsight.functions import dates
from cardsight.operators.filters import require_parsed
from cardsight.operators.rank import global_row_number, global_running_sums

LABEL = "is_fraud"
MEDIAN_BRACKET = 0.002  # share of the rows on either side of the middle within which medians are counted value by value


# ---------------------------------------------------------------- lookups

def join_lookup(df: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a lookup table. Whether it is broadcast is Spark's choice, made
    from the bytes it measures."""
    return df.join(lookup, key, how)


def _written(lookup: DataFrame, name: str) -> DataFrame:
    """A lookup table written and read back. Spark knows a file's bytes before it plans (a checkpoint's it does not, and
    would deal the rows out by a key of a few values), so a small table is broadcast and the rows stay where they are."""
    from cardsight.sources import files
    return files.written(lookup, name)


def rate_table(df: DataFrame, key: str, label: str = LABEL, name: str | None = None) -> DataFrame:
    """A1 as a lookup table: key -> mean label."""
    return df.groupBy(key).agg(F.avg(label).alias(name or f"{key}_rate"))


def with_rate(df: DataFrame, rates: DataFrame, key: str, rate_col: str, default: float,
              out: str | None = None) -> DataFrame:
    """Key -> rate, with the global rate for keys never seen."""
    out = out or rate_col
    joined = join_lookup(df, rates.select(key, F.col(rate_col).alias("_rate")), key)
    return joined.withColumn(out, F.coalesce(F.col("_rate"), F.lit(default))).drop("_rate")


def inverse_lookup(rates: DataFrame, key: str, rate_col: str) -> DataFrame:
    """Rate -> key; keys sharing a rate collapse to the last key in key
    order (the largest)."""
    return rates.groupBy(rate_col).agg(F.max(key).alias(key))


# ---------------------------------------------------------------- target encoding

def fit_target_encoder(df: DataFrame, key: str = "merchant", label: str = LABEL,
                       min_samples_leaf: int = TE_MIN_SAMPLES_LEAF,
                       smoothing: float = TE_SMOOTHING, prior: float | None = None) -> tuple[DataFrame, float]:
    """Per key n and mean label; the encoding blends the mean with the
    prior by ``l = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))``."""
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"))
    if prior is None:
        prior = float(df.agg(F.avg(label)).first()[0])
    lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    enc = stats.withColumn("encoding", F.lit(prior) * (F.lit(1.0) - lam) + F.col("mean") * lam)
    return enc, prior


def apply_target_encoder(df: DataFrame, encoding: DataFrame, prior: float, key: str = "merchant",
                         out: str = "merchant_te") -> DataFrame:
    """Unknown and missing keys get the prior."""
    joined = join_lookup(df, encoding.select(key, F.col("encoding").alias("_enc")), key)
    return joined.withColumn(out, F.coalesce(F.col("_enc"), F.lit(prior))).drop("_enc")


# ---------------------------------------------------------------- codes

def label_codes(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Sorted distinct values numbered from 0 (range-partitioned
    numbering of the distinct values; no single-task window)."""
    code = code or f"{column}_code"
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return global_row_number(distinct, [column], name="_rn").select(
        column, (F.col("_rn") - 1).cast("int").alias(code))


def codes_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """X15 for several columns at once: column, value, code. One grouped pass over (column, value) pairs and one
    numbering of them, segmented by column; nulls have no code."""
    counts = level_counts(df, columns)
    return level_codes(counts.select("column", "value"), columns)[0]


def encode_columns(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """X15 applied: each column replaced by its code."""
    out = df
    for c in columns:
        mine = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_code_{c}"))
        out = join_lookup(out, mine, c).drop(c).withColumnRenamed(f"_code_{c}", c)
    return out.select(*df.columns)


def encode(df: DataFrame, codes: DataFrame, column: str, code: str | None = None) -> DataFrame:
    code = code or f"{column}_code"
    return join_lookup(df, codes, column)


def decode(df: DataFrame, codes: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Codes back to values."""
    code = code or f"{column}_code"
    return join_lookup(df, codes, code)


# ---------------------------------------------------------------- statistics

def exact_medians(df: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> dict[str, float | None]:
    """Exact medians of several columns without sorting every value.

    Approximate quantiles close to both sides of the middle set a bracket for each column. One pass counts the values
    below and within it; only (feature, value) pairs within it are counted one by one, and a
    range-partitioned running sum over them gives each value's rank interval. The one or two values that
    cover the middle ranks are averaged. A column whose middle ranks lie outside its bracket is counted whole.
    Only a few values per column reach the driver. ``counts`` (non-null values per column) saves a pass when known."""
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
        counts = {c: int(row[c]) for c in columns}
    values = {c: F.col(c).cast("double") for c in columns}
    middle = {c: ((counts[c] + 1) // 2, (counts[c] + 2) // 2) for c in columns if counts[c]}
    if not middle:
        return {c: None for c in columns}
    near = [0.5 - MEDIAN_BRACKET, 0.5 + MEDIAN_BRACKET]
    row = df.agg(*[F.percentile_approx(values[c], near, 10000).alias(c) for c in middle]).first()
    bracket = {c: tuple(row[c]) for c in middle}
    inside = {c: (values[c] >= F.lit(lo)) & (values[c] <= F.lit(hi)) for c, (lo, hi) in bracket.items()}
    row = df.agg(*[F.count_if(values[c] < F.lit(bracket[c][0])).alias(f"b_{c}") for c in middle],
                 *[F.count_if(inside[c]).alias(f"i_{c}") for c in middle]).first()
    below, held = {c: int(row[f"b_{c}"]) for c in middle}, {c: int(row[f"i_{c}"]) for c in middle}
    for c, (first, last) in middle.items():
        if first <= below[c] or last > below[c] + held[c]:
            inside[c], below[c], held[c] = values[c].isNotNull(), 0, counts[c]
    pairs = [F.when(inside[c], F.struct(F.lit(c).alias("feature"), values[c].alias("value"))) for c in middle]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).filter("p is not null").select("p.*")
    valued = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    # Where each feature's ranks start in (feature, value) order: one
    # number per feature, computed here from the counts.
    start, acc = {}, 0
    for c in sorted(middle):
        start[c] = acc - below[c]
        acc += held[c]
    wanted = [(c, r) for c in middle for r in {start[c] + middle[c][0], start[c] + middle[c][1]}]
    cum = global_running_sums(valued, ["feature", "value"], ["c"])
    ranks = df.sparkSession.createDataFrame(wanted, "feature string, rank long")
    # The value whose run of ranks (c_cum - c, c_cum] holds the wanted one.
    hits: dict[str, list[float]] = {}
    for r in (cum.join(ranks, "feature").filter("c_cum - c < rank and rank <= c_cum")
              .select("feature", "value").collect()):
        hits.setdefault(r["feature"], []).append(r["value"])
    return {c: (min(hits[c]) + max(hits[c])) / 2.0 if c in hits else None for c in columns}


def approx_medians(df: DataFrame, columns: list[str], accuracy: int = 10000) -> dict[str, float | None]:
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def level_counts(df: DataFrame, columns: list[str], amount: str | None = None) -> DataFrame:
    """column, value, n and, over the rows' ``amount``, n_amount, mean_amount, var_amount: one grouped pass over
    the unpivoted text columns."""
    x = F.col(amount).cast("double") if amount else F.lit(None).cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), x.alias("x")).filter("p.value is not null")
    return long.groupBy("p.column", "p.value").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_amount"), F.avg("x").alias("mean_amount"),
        F.var_pop("x").alias("var_amount"))


def level_codes(counts: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(``counts`` with each level's code, from 0 in sorted order within its column; the number of levels of each column)."""
    numbered = global_row_number(counts, ["column", "value"], name="_rn")
    seen = {r["column"]: (r["first"], r["size"]) for r in numbered.groupBy("column").agg(
        F.min("_rn").alias("first"), F.count(F.lit(1)).alias("size")).collect()}
    first = F.lit(None).cast("bigint")
    for c, (at, _) in seen.items():
        first = F.when(F.col("column") == c, F.lit(at)).otherwise(first)
    return (numbered.withColumn("code", (F.col("_rn") - first).cast("int")).drop("_rn"),
            {c: seen[c][1] if c in seen else 0 for c in columns})


def level_modes(counts: DataFrame) -> dict[str, str]:
    """The most frequent level of each column (ties: the smallest)."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return {r["column"]: r["best"]["v"] for r in counts.groupBy("column").agg(best.alias("best")).collect()}


# ---------------------------------------------------------------- fitted model (M1)

@dataclass
class FeatureModel:
    """What M1 fits. ``levels`` has a row per level of a text column: column, value, code and,
    for the column that is crossed with the amount, the mean, deviation and median of
    that interaction. ``heavy`` are the (at most two) levels whose interaction's median is not 0."""

    te_table: DataFrame
    prior: float
    state_rates: DataFrame | None
    global_rate: float
    num_cols: list[str]
    cat_cols: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    cat_modes: dict[str, str]
    levels: DataFrame
    sizes: dict[str, int]
    crossed: str | None = None
    heavy: list[tuple[int, float, float]] = field(default_factory=list)
    votes: dict = field(default_factory=dict)
    engineered: DataFrame | None = None

    @property
    def offsets(self) -> dict[str, int]:
        """Where each block of the vector starts: plain numbers at 0, then the interactions, each text column, state risk."""
        at = len(self.num_cols)
        out = {"amount": at}
        at += self.sizes[self.crossed] if self.crossed else 0
        for c in self.cat_cols:
            out[c] = at
            at += self.sizes[c]
        return out | {"state_risk": at}

    @property
    def size(self) -> int:
        return self.offsets["state_risk"] + (self.state_rates is not None)

    @property
    def feature_names(self) -> DataFrame:
        """idx, feature, base: the vector's places with their names and the value that a place left out stands for
        (not 0 for a scaled interaction)."""
        at, spark = self.offsets, self.levels.sparkSession
        plain = [(i, f"num__{c}", 0.0) for i, c in enumerate(self.num_cols)]
        if self.state_rates is not None:
            plain.append((at["state_risk"], "state_risk", 0.0))
        out = spark.createDataFrame(plain, "idx int, feature string, base double")
        for c in self.cat_cols:
            out = out.unionByName(self.levels.filter(F.col("column") == c).select(
                (F.col("code") + at[c]).cast("int").alias("idx"), F.concat(F.lit(f"cat__{c}_"), "value").alias("feature"),
                F.lit(0.0).alias("base")))
        if self.crossed:
            out = out.unionByName(self.levels.filter(F.col("column") == self.crossed).select(
                (F.col("code") + at["amount"]).cast("int").alias("idx"),
                F.concat(F.lit(f"num__amt_x_{self.crossed}_"), "value").alias("feature"),
                (-F.col("mean") / _divisor("std")).alias("base")))
        return out


def _feature_list(columns: list[str], ts: str, drop_cols) -> dict[str, Column]:
    """What the engineered frame holds, in order: the passed columns that are
    neither identifying nor used up, then the derived ones whose inputs exist."""
    has = set(columns)
    place = {"amt", "lat", "long", "merch_lat", "merch_long"}
    with_place, with_merchant = place <= has, "merchant" in has
    used = {ts, "dob", *(place if with_place else ()), *(["merchant"] if with_merchant else ())}
    out = {c: F.col(c) for c in columns if c not in used and c not in drop_cols}
    out |= {"age": dates.age_years(ts, "dob"), "txn_hour": dates.hour_of(ts), "txn_dow": dates.day_of_week(ts),
            "txn_month": dates.month_of(ts)}
    if with_merchant:
        out["merchant_te"] = F.col("_merchant_te")
    if with_place:
        out["amt_log"] = F.log1p("amt")
        out["distance"] = F.sqrt(F.pow(F.col("merch_lat") - F.col("lat"), 2) + F.pow(F.col("merch_long") - F.col("long"), 2))
    return out


def engineered(df: DataFrame, te_table: DataFrame, prior: float,
               parse: bool = True, mode: str = "column", drop_cols=HIGH_CARD_COLS,
               keep: tuple[str, ...] = ("trans_num", "state"), votes: dict | None = None) -> DataFrame:
    """The hand-made part of M1 before imputation/scaling, as one projection
    (see ``_feature_list``) over the rows whose times parse (A17, X2, X3, F10):
    age and time parts (X5, X6), merchant encoding (J2), log amount and distance
    (X9, X10), identifying columns left out (P1). The interaction of amount and category
    (X13) follows from these two. ``keep`` columns travel along as keys, not features."""
    out = dates.parse_times(df, mode=mode, votes=votes) if parse else df
    ts = "trans_date_trans_time" if "trans_date_trans_time" in out.columns else "trans_ts"
    out = require_parsed(out, [ts, "dob"], check_empty=False)
    features = _feature_list(out.columns, ts, drop_cols)
    keys = {f"_key_{k}": F.col(k) for k in keep if k in out.columns}
    if "merchant" in out.columns:
        out = apply_target_encoder(out, te_table, prior, out="_merchant_te")
    return out.select(*[c.alias(name) for name, c in (features | keys).items()])


def split_types(df: DataFrame, exclude=(LABEL,)) -> tuple[list[str], list[str]]:
    """Numeric and text columns of a frame, in column order."""
    num, cat = [], []
    for name, dtype in df.dtypes:
        if name in exclude or name.startswith("_"):
            continue
        if dtype == "string":
            cat.append(name)
        elif dtype in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean") \
                or dtype.startswith("decimal"):
            num.append(name)
    return num, cat


def fit_features(raw: DataFrame, parse: bool = True, mode: str = "column", exact: bool = True,
                 drop_first=SAMPLER_DROP_COLS, keep_engineered: bool = False) -> FeatureModel:
    """Fit M1 on a raw training frame (unbalanced, with labels).

    Passes over the raw feed: one aggregation for the format votes and the
    prior; one that parses the times and writes the rows. From there one grouped
    pass for the lookups (merchant encoder statistics, state rates) and one to build the
    engineered frame, which is written too (as columns, compressed) and read
    for one statistics pass, the exact medians and one grouped count of all levels. ``keep_engineered``: the model
    carries it."""
    from cardsight.sources import files
    raw = raw.drop(*[c for c in drop_first if c in raw.columns and c != "trans_num"], "fraud_score")
    # One pass: format votes and the prior.
    spec = dates.time_columns(raw) if parse and mode == "column" else {}
    votes = dates.vote_formats(raw, spec, extra_aggs={"prior": F.avg(LABEL)})
    prior = float(votes.pop("_extra")["prior"] or 0.0)
    # Parsed once; the lookups and the engineered frame both read this table.
    if parse:
        raw = files.written(dates.parse_times(raw, mode=mode, votes=votes or None), "parsed")
    # Merchant encoder statistics and state rates come from one grouped pass over (lookup, key) pairs.
    keyed = [k for k in ("merchant", "state") if k in raw.columns]
    lookups = None
    if keyed:
        pairs = raw.select(F.col(LABEL), F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keyed])).alias("p"))
        lookups = _written(pairs.groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean")), "lookups")

    def _lookup(kind: str) -> DataFrame:
        return lookups.filter((F.col("kind") == kind) & F.col("key").isNotNull()).withColumnRenamed("key", kind)

    if "merchant" in keyed:
        lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(TE_MIN_SAMPLES_LEAF)) / F.lit(float(TE_SMOOTHING))))
        te_table = _lookup("merchant").select(
            "merchant", "n", "mean", (F.lit(prior) * (F.lit(1.0) - lam) + F.col("mean") * lam).alias("encoding"))
    else:
        te_table, _ = fit_target_encoder(raw, prior=prior)
    state_rates = _lookup("state").select("state", F.col("mean").alias("state_rate")) if "state" in keyed else None
    eng = engineered(raw, te_table, prior, parse=False)
    # Written once: the statistics below and ``fit_transform`` read the columns that they need.
    eng = files.written(eng, "engineered")
    num_cols, cat_cols = split_types(eng)
    row = eng.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n_{c}") for c in num_cols],
                  *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in num_cols],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in num_cols]).first()
    if not row["_n"]:
        raise ValueError("no row of the feed has both times: nothing to fit")
    counts = {c: int(row[f"n_{c}"]) for c in num_cols}
    crossed = "category" if "category" in cat_cols and "amt_log" in num_cols else None
    found = level_counts(eng, cat_cols, "amt_log" if crossed else None).checkpoint(eager=True)
    levels, sizes = level_codes(found, cat_cols)
    heavy = _heavy_levels(found, crossed, counts["amt_log"]) if crossed else []
    # The interactions of heavy levels need their medians taken; all others' are 0.
    named = {f"_heavy_{i}": F.col("amt_log") * F.when(F.col(crossed) == v, 1.0).otherwise(0.0)
             for i, v in enumerate(heavy)}
    wide = eng.withColumns(named) if named else eng
    medians = exact_medians(wide, [*num_cols, *named], counts | dict.fromkeys(named, counts.get("amt_log", 0))) \
        if exact else approx_medians(wide, [*num_cols, *named])
    at_heavy = {v: medians.pop(f"_heavy_{i}") or 0.0 for i, v in enumerate(heavy)}
    levels = _written(_interaction_stats(levels, crossed, row["_n"], counts.get("amt_log", 0), at_heavy), "levels")
    means = {c: row[f"m_{c}"] for c in num_cols}
    stds = {c: row[f"s_{c}"] for c in num_cols}
    with_nulls = [c for c in num_cols if counts[c] < row["_n"]]
    if with_nulls:  # scaler statistics are taken after median imputation
        imputed = eng.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c)
                               for c in with_nulls])
        r2 = imputed.agg(*[F.avg(c).alias(f"m_{c}") for c in with_nulls],
                         *[F.stddev_pop(c).alias(f"s_{c}") for c in with_nulls]).first()
        means.update({c: r2[f"m_{c}"] for c in with_nulls})
        stds.update({c: r2[f"s_{c}"] for c in with_nulls})
    modes = level_modes(found) if cat_cols else {}
    model = FeatureModel(te_table, prior, state_rates, prior, num_cols, cat_cols, medians, means, stds,
                         {c: modes.get(c) for c in cat_cols}, levels, sizes, crossed, votes=votes)
    if heavy:
        model.heavy = [(r["code"], r["median"], r["std"] or 1.0) for r in levels.filter(
            (F.col("column") == crossed) & F.col("value").isin(heavy)).orderBy("code").collect()]
    if keep_engineered:
        model.engineered = eng
    return model


def _heavy_levels(found: DataFrame, crossed: str, n_amounts: int) -> list[str]:
    """The levels that half or more of the rows with an amount have (two at most): elsewhere zeros hold the median."""
    rows = found.filter((F.col("column") == crossed) & (F.col("n_amount") * 2 >= n_amounts) & (F.col("n_amount") > 0))
    return sorted(r["value"] for r in rows.select("value").collect())


def _interaction_stats(levels: DataFrame, crossed: str | None, n: int, n_amounts: int, medians: dict[str, float]) -> DataFrame:
    """``levels`` with median, mean and deviation of each level's amount interaction over all rows: the
    level's amounts, zeros elsewhere, the median where the amount is missing."""
    if not crossed:
        return levels.select("column", "value", "code", *[F.lit(None).cast("double").alias(c) for c in ("median", "mean", "std")])
    med = F.lit(0.0)
    for v, m in medians.items():
        med = F.when((F.col("column") == crossed) & (F.col("value") == v), F.lit(float(m))).otherwise(med)
    own, missing = F.col("n_amount"), F.lit(float(n - n_amounts))
    mean_in, var_in = (F.coalesce(c, F.lit(0.0)) for c in ("mean_amount", "var_amount"))
    mean = (own * mean_in + missing * F.col("median")) / F.lit(float(n))
    spread = (own * (var_in + F.pow(mean_in - F.col("mean"), 2)) + (F.lit(float(n_amounts)) - own) * F.pow("mean", F.lit(2))
              + missing * F.pow(F.col("median") - F.col("mean"), 2)) / F.lit(float(n))
    return (levels.withColumn("median", med).withColumn("mean", mean).withColumn("std", F.sqrt(spread))
            .select("column", "value", "code", "median", "mean", "std"))


def _divisor(std: str) -> Column:
    """X11: a deviation of 0 divides by 1."""
    return F.when(F.col(std) > 0, F.col(std)).otherwise(1.0)


def save_features(model: FeatureModel, path: str) -> None:
    """The fitted model under ``path``: its two lookups as Parquet, its
    values (a few per column) as one row of JSON."""
    spark = model.te_table.sparkSession
    model.te_table.write.mode("overwrite").parquet(f"{path}/merchant_te")
    model.levels.write.mode("overwrite").parquet(f"{path}/levels")
    if model.state_rates is not None:
        model.state_rates.write.mode("overwrite").parquet(f"{path}/state_rates")
    values = {f.name: getattr(model, f.name) for f in fields(model)
              if f.name not in ("te_table", "state_rates", "levels", "votes", "engineered")}
    values["has_state_rates"] = model.state_rates is not None
    values["votes"] = {c: asdict(v) for c, v in model.votes.items()}
    spark.createDataFrame([(json.dumps(values),)], "value string").write.mode("overwrite").text(f"{path}/values")


def load_features(spark: SparkSession, path: str) -> FeatureModel:
    """A model written by ``save_features``."""
    values = json.loads(spark.read.text(f"{path}/values").first()[0])
    rates = spark.read.parquet(f"{path}/state_rates") if values.pop("has_state_rates") else None
    votes = {c: dates.FormatVote(**v) for c, v in values.pop("votes").items()}
    return FeatureModel(te_table=spark.read.parquet(f"{path}/merchant_te"), state_rates=rates,
                        levels=spark.read.parquet(f"{path}/levels"), votes=votes, **values)


def scale(col: str, model: FeatureModel) -> Column:
    """X11: impute the median, subtract the mean, divide by the population
    deviation (1 when the deviation is 0)."""
    std = model.stds[col]
    std = 1.0 if std is None or std == 0 else std
    mean = model.means[col] if model.means[col] is not None else 0.0
    med = model.medians[col]
    x = F.col(col).cast("double")
    if med is not None:
        x = F.coalesce(x, F.lit(med))
    return (x - F.lit(mean)) / F.lit(std)


def transform(df: DataFrame, model: FeatureModel, parse: bool = True, mode: str = "column",
              with_label: bool = True, reuse_votes: bool = False, carry: tuple[str, ...] = (),
              parts: bool = False, stored: bool = False) -> DataFrame:
    """M1 (+ J1, P2): raw rows -> ``features``, a sparse vector whose places ``model.feature_names``
    names; ``trans_num`` and ``state`` kept as keys, the label kept when present.
    Columns the model expects but the input lacks are added as null and imputed;
    unexpected columns are dropped, but for those to ``carry``. Formats are voted on
    the frame being transformed unless ``reuse_votes`` (same feed as the fit).
    With ``parts`` also what the vector is made of, ``stored``: as it lies in files (see ``finish``)."""
    votes = (model.votes or None) if reuse_votes else None
    eng = engineered(df, model.te_table, model.prior, parse=parse, mode=mode, votes=votes,
                     keep=("trans_num", "state", *carry))
    return finish(eng, model, with_label, parts, stored)


def finish(eng: DataFrame, model: FeatureModel, with_label: bool = True, parts: bool = False, stored: bool = False) -> DataFrame:
    """Imputation, scaling, level codes, interactions and the state risk on an
    engineered frame, put together as the vector ``features``.

    X12: a level's code (joined by key; unknown levels have none) is the place of its 1.
    X13: a row's interaction with its own level is the only one that is not at its
    base value; the vector holds the difference from that base, ``amt_log`` over the
    deviation. ``parts``: also the columns ``num__*`` (scaled), ``code__*``, ``crossed``
    ((place, difference) pairs) and ``state_risk``. ``stored``: the vector as the struct that files hold, which is read
    as a vector under ``vector_schema``: made without a detour through text."""
    eng = eng.withColumns({c: F.lit(None).cast("double" if c in model.num_cols else "string")
                           for c in model.num_cols + model.cat_cols if c not in eng.columns})
    for c in model.cat_cols:
        levels = model.levels.filter(F.col("column") == c).select(
            F.col("value").alias(f"_fill_{c}"), F.col("code").alias(f"code__{c}"),
            *([_divisor("std").alias("_x_std")] if c == model.crossed else []))
        eng = join_lookup(eng.withColumn(f"_fill_{c}", F.coalesce(F.col(c), F.lit(model.cat_modes[c]))), levels, f"_fill_{c}")
    keys = [F.col(k).alias(k.removeprefix("_key_")) for k in eng.columns if k.startswith("_key_")]
    label = [F.col(LABEL)] if with_label and LABEL in eng.columns else []
    pair = "array<struct<idx:int,value:double>>"
    crossed = F.array().cast(pair)
    if model.crossed:
        own = F.array(F.struct(F.col(f"code__{model.crossed}").alias("idx"), (F.col("amt_log") / F.col("_x_std")).alias("value")))
        # Without an amount every interaction is at its median: 0 but for the heavy levels.
        unknown = F.array(*[F.struct(F.lit(code).alias("idx"), F.lit(med / std).alias("value"))
                            for code, med, std in model.heavy]).cast(pair)
        known = F.col(model.crossed).isNotNull() & F.col(f"code__{model.crossed}").isNotNull()
        crossed = F.when(F.col("amt_log").isNull(), unknown).when(known, own.cast(pair)).otherwise(F.array().cast(pair))
    out = eng.select(*keys, *[scale(c, model).alias(f"num__{c}") for c in model.num_cols],
                     *[f"code__{c}" for c in model.cat_cols], crossed.alias("crossed"), *label)
    if model.state_rates is not None and "state" in out.columns:
        out = with_rate(out, model.state_rates, "state", "state_rate", model.global_rate, out="state_risk")
    out = out.withColumn("features", _vector(model, "state_risk" in out.columns, stored))
    if not parts:
        out = out.drop(*[f"num__{c}" for c in model.num_cols], *[f"code__{c}" for c in model.cat_cols], "crossed", "state_risk")
    return out


def _vector(model: FeatureModel, with_risk: bool, stored: bool = False) -> Column:
    """The sparse vector of a finished row, from (place, value) pairs in ascending order of places."""
    at = model.offsets

    def place(idx: Column, value: Column) -> Column:
        return F.struct(idx.cast("int").alias("idx"), value.cast("double").alias("value"))

    pairs = [F.array(*[place(F.lit(i), F.coalesce(F.col(f"num__{c}"), F.lit(float("nan")))) for i, c in enumerate(model.num_cols)]),
             F.transform("crossed", lambda p: place(p["idx"] + at["amount"], p["value"]))]
    pairs += [F.when(F.col(f"code__{c}").isNotNull(), F.array(place(F.col(f"code__{c}") + at[c], F.lit(1.0))))
              .otherwise(F.array().cast("array<struct<idx:int,value:double>>")) for c in model.cat_cols]
    if with_risk:
        pairs.append(F.array(place(F.lit(at["state_risk"]), F.col("state_risk"))))
    flat = F.concat(*pairs)
    return (stored_vector if stored else sparse_vector)(F.lit(model.size), F.transform(flat, lambda p: p["idx"]), F.transform(flat, lambda p: p["value"]))


def stored_vector(size: Column, indices: Column, values: Column) -> Column:
    """(index, value) pairs as the struct in which a ``VectorUDT`` column lies in files and Arrow batches."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))


def vector_schema(schema: T.StructType) -> T.StructType:
    """``schema`` with its stored ``features`` as a vector: files are read with it."""
    return T.StructType([T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in schema.fields])


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """A ``VectorUDT`` column of (index, value) pairs, made by Spark's own functions. (A struct cannot be cast to the
    vector type; the JSON reader takes the type that it is told.)"""
    parts = F.struct(stored_vector(size, indices, values).alias("v"))
    return F.from_json(F.to_json(parts), T.StructType([T.StructField("v", VectorUDT())]))["v"]


def feature_summary(out: DataFrame, model: FeatureModel) -> DataFrame:
    """feature, lo, hi, sq (mean square) and n of every feature, from a frame with ``parts``.

    Plain numbers take one aggregation; for levels and interactions the rows that
    hold them are grouped by code, and all other rows count with the base value."""
    at = model.offsets
    plain = [f"num__{c}" for c in model.num_cols] + (["state_risk"] if "state_risk" in out.columns else [])
    z = {c: F.col(c).cast("double") for c in plain}
    wide = out.agg(F.count(F.lit(1)).alias("n"), *[F.min(z[c]).alias(f"a{i}") for i, c in enumerate(plain)],
                   *[F.max(z[c]).alias(f"b{i}") for i, c in enumerate(plain)],
                   *[F.avg(z[c] * z[c]).alias(f"q{i}") for i, c in enumerate(plain)]).persist()
    n = wide.first()["n"]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("lo"), F.col(f"b{i}").alias("hi"),
                               F.col(f"q{i}").alias("sq")) for i, c in enumerate(plain)])
    res = wide.select(F.explode(cells).alias("p"), "n").select("p.*", "n")
    one_place = [F.struct((F.col(f"code__{c}") + at[c]).alias("idx"), F.lit(1.0).alias("value")) for c in model.cat_cols]
    held = out.select(F.explode(F.concat(
        F.transform("crossed", lambda p: F.struct((p["idx"] + at["amount"]).alias("idx"), p["value"].alias("value"))),
        F.array(*one_place) if one_place else F.array().cast("array<struct<idx:int,value:double>>"))).alias("p"))
    sums = (held.select("p.*").filter("idx is not null").groupBy("idx")
            .agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"),
                 F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")))
    names = model.feature_names.filter((F.col("idx") >= len(model.num_cols)) & (F.col("idx") < at["state_risk"]))
    b, k = F.col("base"), F.coalesce(F.col("k"), F.lit(0))
    outside = F.when(k < n, b)
    level = names.join(sums, "idx", "left").select(
        "feature", F.least(b + F.col("lo"), outside).alias("lo"), F.greatest(b + F.col("hi"), outside).alias("hi"),
        (b * b + (F.lit(2.0) * b * F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))) / F.lit(n)).alias("sq"),
        F.lit(n).cast("bigint").alias("n"))
    return res.unionByName(level)


def fit_transform(raw: DataFrame, parse: bool = True, mode: str = "column",
                  exact: bool = True, parts: bool = False, stored: bool = False) -> tuple[FeatureModel, DataFrame]:
    """M1 in training mode: fit, and the training rows' features from the
    same (written) engineered frame."""
    model = fit_features(raw, parse=parse, mode=mode, exact=exact, keep_engineered=True)
    return model, finish(model.engineered, model, parts=parts, stored=stored)


def drop_columns(df: DataFrame, columns, strict: bool = False) -> DataFrame:
    """Without the given columns. ``strict``: each of them has to be there; else the missing ones are passed over."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*[c for c in columns if c in df.columns])


def align(df: DataFrame, expected: list[str], fill_type: str = "double") -> DataFrame:
    """Expected columns in order; missing ones null, extra ones dropped."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).cast(fill_type).alias(c) for c in expected])


def downcast(df: DataFrame, prefix: str = "num__") -> DataFrame:
    """Numeric feature columns to 32-bit floats."""
    return df.select(*[F.col(c).cast("float").alias(c) if c.startswith(prefix) else F.col(c) for c in df.columns])


def scaled_hour_interaction(df: DataFrame, hour: str = "txn_hour", column: str = "category") -> DataFrame:
    """X14 (as intended): hour standardised with the sample deviation, as the value that the row has at its own
    level of ``column`` (``hour_x``); its values at all other levels are 0."""
    stats = df.agg(F.avg(hour).alias("m"), F.stddev_samp(hour).alias("s")).first()
    s = stats["s"] if stats["s"] else 1.0
    return df.withColumn(f"hour_x_{column}", (F.col(hour) - F.lit(stats["m"])) / F.lit(s))
