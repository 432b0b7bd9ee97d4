from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.operators import text as tt
from corpuslab.operators.ranking import exact_rank
from corpuslab.plans import views
from corpuslab.sources.tables import table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_rank_single_partition_only_over_partition_counts(spark):
    """A global rank must not move rows through one partition: the only SinglePartition
    exchange allowed sits on the per-partition count table (one row per partition)."""
    df = spark.range(5000).withColumn("g", F.lit(1))
    lines = _plan(exact_rank(df, ["id"], name="r")).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_pid" in lines[i + 1]


def test_vocab_join_is_broadcast_when_small(spark):
    voc = views.vocab(spark, SF_SMALL)
    plan = _plan(tt.encode(views.tok(spark, SF_SMALL), voc))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_filters_and_columns_reach_the_scan(spark):
    ev = table(spark, SF_SMALL, "events").where(F.col("event_type") == "view").select("user_id")
    plan = _plan(ev)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
