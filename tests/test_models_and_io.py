"""Models, tuning, model/lookup persistence, argument checks."""

import pytest
from pyspark.sql import functions as F

from cardsight.operators import features as fe
from cardsight.operators import filters as flt
from cardsight.operators import models as ml
from cardsight.plans.common import txn
from cardsight.sources import files, tables

from testdata_paths import SF_SMALL


@pytest.fixture(scope="module")
def feats(spark):
    raw = tables.txn_text_view(txn(spark, SF_SMALL), spoil_mod=50)
    model = fe.fit_features(raw)
    return model, fe.transform(raw, model, reuse_votes=True).checkpoint(eager=True)


@pytest.fixture(scope="module")
def table(spark, feats):
    some = feats[1].filter("state in ('NATION_1', 'NATION_2', 'NATION_3')") \
        .withColumn("state", F.when(F.col("state") == "NATION_3", None).otherwise(F.col("state")))
    return ml.write_training_table(some, files.scratch_path(spark, "training"))


def test_split_types_and_feature_names(feats):
    model, out = feats
    assert model.num_cols == ["city_pop", "age", "txn_hour", "txn_dow", "txn_month", "merchant_te", "amt_log", "distance"]
    assert model.cat_cols == ["category", "state"]
    names = {r["idx"]: r["feature"] for r in model.feature_names.collect()}
    assert sorted(names) == list(range(model.size)) and out.first()["features"].size == model.size
    assert names[0] == "num__city_pop" and names[model.size - 1] == "state_risk"
    assert sum(n.startswith("num__amt_x_category_") for n in names.values()) == model.sizes["category"]


def test_sparse_vector_equals_columns(spark, feats):
    """A row's vector over its base values is the dense row: scaled numbers, interactions, one-hot levels, risk."""
    from math import log1p
    model, _ = feats
    raw = tables.txn_text_view(txn(spark, SF_SMALL), spoil_mod=50).limit(40)
    extra = raw.limit(1).withColumn("category", F.lit("unseen")).withColumn("trans_num", F.lit("x-1"))
    extra = extra.unionByName(raw.limit(1).withColumn("amt", F.lit(None).cast("double")).withColumn("trans_num", F.lit("x-2")))
    rows = {r["trans_num"]: r for r in raw.unionByName(extra).collect()}
    names = {r["idx"]: (r["feature"], r["base"]) for r in model.feature_names.collect()}
    stats = {(r["column"], r["value"]): r for r in model.levels.collect()}
    for got in fe.transform(raw.unionByName(extra), model, reuse_votes=True).collect():
        src, dense = rows[got["trans_num"]], got["features"].toArray()
        for i, (name, base) in names.items():
            if name.startswith("cat__"):
                column, value = name.split("_", 3)[2], name.split("_", 3)[3]
                assert dense[i] == float(src[column] == value)
            elif name.startswith("num__amt_x_category_"):
                r = stats["category", name.removeprefix("num__amt_x_category_")]
                x = r["median"] if src["amt"] is None else log1p(src["amt"]) * (src["category"] == r["value"])
                assert dense[i] + base == pytest.approx((x - r["mean"]) / (r["std"] or 1.0), abs=1e-9)


def test_a_hundred_thousand_levels(spark):
    """Levels are rows of a table: no column and no list of the driver's grows with them."""
    n = 100_000
    raw = spark.range(n).selectExpr(
        "cast(id as string) as trans_num", "cast('2000-01-01 00:00:00' as timestamp_ntz) as trans_ts",
        "cast('1980-01-01 00:00:00' as timestamp_ntz) as dob", "concat('m', id % 50) as merchant", "concat('c', id) as category",
        "concat('s', id % 9) as state", "cast(id % 700 as double) as amt", "1.0D as lat", "2.0D as long", "1.5D as merch_lat",
        "2.5D as merch_long", "cast(id % 2 as int) as is_fraud")
    model, out = fe.fit_transform(raw, parse=False)
    assert model.sizes == {"category": n, "state": 9} and len(out.columns) < 10
    assert not any(isinstance(v, (list, dict)) and len(v) > 100 for v in vars(model).values())
    places = len(model.num_cols) + 2 * n + 9 + 1
    some = out.select("features").limit(200).collect()
    assert all(r["features"].size == places and len(r["features"].indices) == len(model.num_cols) + 4 for r in some)
    held = fe.finish(model.engineered, model, parts=True).drop("features")
    assert held.select("code__category").distinct().count() == n


def test_running_sums_use_no_window(spark):
    from cardsight.operators.rank import global_running_sums, running_sums_by
    df = spark.range(5000).selectExpr("id % 7 as k", "cast(id as double) / 3 as v", "id % 5 as c")
    for out in (global_running_sums(df, ["v"], ["c"], totals=True), running_sums_by(df, "k", ["v"], ["c"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    assert "Exchange hash" not in global_running_sums(df, ["v"], ["c"])._jdf.queryExecution().executedPlan().toString()
    row = global_running_sums(df, ["v"], ["c", "v"], num_partitions=6, totals=True).orderBy(F.desc("v")).first()
    assert row["c_cum"] == row["c_total"] == 10_000 and abs(row["v_cum"] - row["v_total"]) < 1e-6
    empty = global_running_sums(df.limit(0), ["v"], ["c"], totals=True)
    assert empty.count() == 0


def test_training_table_is_rebalanced_by_state(spark, feats, table):
    _, out = feats
    full = {r["state"]: (r["n"], r["p"]) for r in out.groupBy("state").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("p")).collect()}
    full[None] = full.pop("NATION_3")
    got = ml.state_counts(table)
    assert len(got) == 3
    for state, (n, p) in got.items():
        m, big = sorted((full[state][1], full[state][0] - full[state][1]))
        grown = max(big // 2, m) if m else 0
        kept = min(big, grown) if m else big
        assert (n, min(p, n - p)) == (grown + kept, min(grown, kept))
    # Rows themselves are never repeated, draws are rows of the minority, and none is made up.
    own = table.filter("draw = 0")
    assert own.select("trans_num", "state", "is_fraud").exceptAll(
        out.select("trans_num", F.when(F.col("state") == "NATION_3", None).otherwise(F.col("state")).alias("state"), "is_fraud")).count() == 0
    assert table.filter("draw > 0").join(own.select("trans_num"), "trans_num", "left_anti").count() == 0


def test_a_fit_reads_its_own_partition(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        for state, wanted in (("NATION_1", "= NATION_1)"), (None, "isnull(state")):
            plan = ml.state_rows(table, state, None, 1, 1)._jdf.queryExecution().executedPlan().toString()
            assert wanted in plan.split("PartitionFilters: [")[1].split("]")[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_a_class_that_the_sample_misses_is_added(spark):
    rows = spark.range(500).selectExpr("cast(id as string) as trans_num", "0L as draw", "cast(id = 77 as int) as is_fraud", "'a' as state")
    some = ml.state_rows(rows, "a", 5, 500, 1)
    assert {r["is_fraud"] for r in some.collect()} == {0, 1} and some.count() <= 6


def test_registry_gives_back_the_ensemble(spark, feats, table):
    _, out = feats
    fitted = ml.train_state_models(table, num_trees=4, max_depth=3)
    assert [m.state for m in fitted] == ["NATION_1", "NATION_2", None]
    boosted = ml.train_state_models(table, kind="boosted", max_depth=2, round=2, settings={s: {"maxIter": 2} for s in (None, "NATION_1", "NATION_2")})
    path = files.scratch_path(spark, "registry")
    ml.register_models(spark, fitted, path)
    assert [m.state for m in ml.load_ensemble(spark, path)] == [m.state for m in fitted if m.trained]
    ml.register_models(spark, boosted, path)
    last, every = ml.load_ensemble(spark, path), ml.load_ensemble(spark, path, "all")
    assert {m.kind for m in last} == {"boosted"} and [m.round for m in every] == [1] * len(last) + [2] * len(last)
    assert abs(sum(ml.row_weights(every)) - 1.0) < 1e-9
    some = out.limit(200)

    def scores(models):
        return sorted((r["trans_num"], round(r["probability"], 9)) for r in ml.ensemble_scores(some, models).collect())
    assert scores(ml.load_ensemble(spark, path, [1])) == scores(fitted) and scores(last) == scores(boosted)
    with pytest.raises(LookupError):
        ml.load_ensemble(spark, path, [7])


def test_ensemble_in_place_equals_model_by_model(spark, feats, table):
    from pyspark.ml.functions import vector_to_array
    _, out = feats
    once = out.groupBy("trans_num").count().filter("count = 1").select("trans_num")  # the data repeat a few ids
    out = out.join(once, "trans_num", "left_semi").limit(400).checkpoint()
    models = ml.train_state_models(table, num_trees=3, max_depth=3)
    got = {}
    for r in ml.ensemble_scores(out.unionByName(out), models).select("trans_num", "probability").collect():
        got.setdefault(r["trans_num"], set()).add(round(r["probability"], 9))  # repeated keys must not add up
    want = {}
    for m, w in zip(models, ml.row_weights(models)):
        for r in m.model.transform(out).select("trans_num", vector_to_array("probability")[1].alias("p")).collect():
            want[r["trans_num"]] = want.get(r["trans_num"], 0.0) + w * r["p"]
    assert got == {k: {round(v, 9)} for k, v in want.items()}


def test_tuned_settings_are_fitted(spark, table):
    grid = {"max_depth": [1, 3], "ratio": [1.0]}
    tuned = ml.tune_per_state(table, grid=grid, folds=2, num_trees=2)
    assert all(t["setting"] in ({"max_depth": 1, "ratio": 1.0}, {"max_depth": 3, "ratio": 1.0}) for t in tuned if t["setting"])
    fitted = ml.train_state_models(table, num_trees=2, settings={t["state"]: t["setting"] for t in tuned})
    for m, t in zip(fitted, tuned):
        assert m.trained == (t["setting"] is not None)
        assert not m.trained or m.model.getOrDefault("maxDepth") == t["setting"]["max_depth"]


def test_tuning_query_uses_whole_forests(spark, table, monkeypatch):
    from cardsight.plans import q_models
    trees, make = [], ml.make_classifier
    monkeypatch.setattr(ml, "make_classifier", lambda kind, num_trees=None, **more: trees.append(num_trees) or make(kind, 2, **more))
    monkeypatch.setattr(ml, "FOREST_GRID", {"max_depth": [2], "subsamplingRate": [1.0], "ratio": [1.0]})
    monkeypatch.setattr(q_models, "trained", lambda spark, sf_dir: (None, table, None, None, None))
    n = q_models.m03_tuning(spark, "").filter("fitted").count()
    assert n and set(trees) == {200} and len(trees) == n * 6


def test_a_version_is_seen_whole_or_not_at_all(spark, monkeypatch):
    from cardsight.sources import versions
    root = files.scratch_path(spark, "tables")
    names = ("all", "new", "fraud", "cases")
    with pytest.raises(LookupError):
        versions.current(spark, root)
    versions.publish(spark, root, {n: spark.range(3) for n in names})

    def seen():
        return {n: t.count() for n, t in versions.current(spark, root).items()}
    assert seen() == dict.fromkeys(names, 3)
    written, write = [], versions.write_parquet

    def stops(df, path):
        if len(written) == 2:
            raise OSError("stopped between writes")
        written.append(path)
        return write(df, path)
    monkeypatch.setattr(versions, "write_parquet", stops)
    with pytest.raises(OSError):
        versions.publish(spark, root, {n: spark.range(5) for n in names})
    assert seen() == dict.fromkeys(names, 3) and len(written) == 2
    monkeypatch.setattr(versions, "write_parquet", write)
    assert versions.publish(spark, root, {n: spark.range(5) for n in names}) == 2
    assert seen() == dict.fromkeys(names, 5)


def test_stream_epochs_number_on_and_replays_repeat(spark):
    from cardsight.streaming import scoring
    out = files.scratch_path(spark, "routed")

    def batch(a, b):
        return spark.range(a, b).selectExpr(
            "cast(id as string) as trans_num", "timestamp_ntz'2001-01-01 00:00:00' as trans_ts", "cast(id as double) as amt",
            "case when id % 7 = 0 then '' else 'm' end as merchant", "id % 3 / 2.0D as fraud_score")

    def checker(df):
        return scoring.reject_reasons(df, ["trans_num", "merchant"])

    def ids():
        got = {}
        for name, column in (("all", "record_id"), ("new", "record_id"), ("fraud", "record_id"), ("cases", "case_id")):
            rows = spark.read.parquet(f"{out}/{name}").select(column, "trans_num").collect()
            got[name] = sorted((r[0], r[1]) for r in rows)
            assert [i for i, _ in got[name]] == list(range(1, len(rows) + 1))
        return got
    for epoch, (a, b) in enumerate(((1, 30), (30, 50), (50, 50), (50, 90))):
        scoring.process_batch(batch(a, b), epoch, out, lambda df: df, checker)
    first = ids()
    rejected = spark.read.parquet(f"{out}/rejected")
    assert rejected.count() + len(first["all"]) == 89 and {r["reason"] for r in rejected.collect()} == {"incomplete"}
    # The last epoch is replayed as if its ledger entry had not been written.
    kept = spark.read.parquet(f"{out}/_epochs").filter("epoch < 3").collect()
    spark.createDataFrame(kept, scoring._LEDGER).write.mode("overwrite").parquet(f"{out}/_epochs")
    scoring.process_batch(batch(50, 90), 3, out, lambda df: df, checker)
    scoring.process_batch(batch(50, 90), 3, out, lambda df: df, checker)
    assert ids() == first


def test_aliases_defaults_and_strict_drop(spark):
    from cardsight.operators import cases as cmd
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1)], "txn_id string, amount double, is_fraud int")
    got = cmd.with_defaults(cmd.to_fields(rows)).orderBy("trans_num").collect()
    assert [(r["trans_num"], r["amt"], r["is_fraud"]) for r in got] == [("a", 1.0, 0), ("b", 2.0, 1)]
    assert cmd.to_aliases(cmd.to_fields(rows)).columns == rows.columns
    assert fe.drop_columns(rows, ["amount", "zip"]).columns == ["txn_id", "is_fraud"]
    with pytest.raises(KeyError):
        fe.drop_columns(rows, ["amount", "zip"], strict=True)


def test_argument_checks():
    with pytest.raises(ValueError):
        flt.check_bucket("archive")
    with pytest.raises(ValueError):
        flt.check_status("pending")
    with pytest.raises(ValueError):
        flt.check_granularity("week")
    with pytest.raises(ValueError):
        tables.bucket(None, "nope")


def test_export_of_empty_bucket_is_an_error(spark):
    t = txn(spark, SF_SMALL).filter("false")
    with pytest.raises(LookupError):
        files.export_csv(t, files.scratch_path(spark, "empty"))


def test_forests_keep_node_ids_and_stay_the_same(spark, table):
    rows = ml.with_weights(ml.state_rows(table, "NATION_1", 500, *ml.state_counts(table)["NATION_1"]).coalesce(1).cache())
    trees = {}
    for kept in (True, False):
        model = ml.make_classifier(num_trees=12, max_depth=6, **({} if kept else {"cacheNodeIds": False})).fit(rows)
        assert model.getCacheNodeIds() == kept
        trees[kept] = model.toDebugString.split("\n", 1)[1]
    assert trees[True] == trees[False]
