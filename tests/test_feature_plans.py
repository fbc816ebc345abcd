"""Small lookups are broadcast: the rows of a feed are not dealt out by a key of a few values."""

from cardsight.operators import features as fe
from cardsight.plans.common import txn
from cardsight.sources import tables

from testdata_paths import SF_SMALL


def test_rows_stay_where_they_are(spark):
    model, out = fe.fit_transform(tables.txn_text_view(txn(spark, SF_SMALL), spoil_mod=50))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastHashJoin") == 3
    parts = model.engineered.rdd.getNumPartitions()
    assert out.rdd.getNumPartitions() == parts
