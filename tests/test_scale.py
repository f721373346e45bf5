"""Plans and partitions that keep a step's figures in proportion to its input."""

from cohortloom import queries
from cohortloom.operators import masks, matching, pooling, quantiles
from cohortloom.plans.scratch import kept
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_do_not_shuffle_values_by_group(spark):
    group = F.struct(F.lit(0).alias("_none"))
    values = kept(spark.range(100).select(group.alias("_g"), F.col("id").cast("double").alias("_v")))
    state = kept(spark.range(1).select(group.alias("_g"), F.lit(50).cast("long").alias("rank"), F.lit(0.0).alias("lo"), F.lit(99.0).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(100).cast("long").alias("inside")))
    plan = plan_of(quantiles._narrowed(values, state, 10))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_maps_of_one_partition_are_dealt_to_many_tasks(spark):
    maps = spark.range(8).selectExpr("id AS item", "int(id % 2) AS fold", "cast('x' AS binary) AS probability", "cast('x' AS binary) AS other", "0.5D AS presence").coalesce(1)
    settings = spark.createDataFrame([(k, 0.5, 0.4) for k in range(2)], "fold int, threshold double, presence_threshold double")
    priors = settings.select("fold", F.lit(0).cast("long").alias("n"), F.lit(None).cast("map<string,struct<centre:double,scale:double>>").alias("prior"))
    assert masks.predict_masks(maps, settings, priors, 8).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_thresholds_are_made_after_the_join(spark, sf):
    """The plan is told from its end: the explode comes before the join there, so a line or an order is one row up to it."""
    plan = plan_of(queries.QUERIES["mask_threshold_search"](spark, sf))
    assert 0 < plan.index("Generate explode") < plan.index("Join")


def test_neighbours_are_found_once_for_a_matching(spark, sf, monkeypatch):
    """Calipers and core pairs read the edges several times."""
    real, plans = matching.calipers, []
    monkeypatch.setattr(matching, "calipers", lambda edges: (plans.append(plan_of(edges)), real(edges))[1])
    queries.QUERIES["core_matching"](spark, sf)
    assert plans and not any("CoGroups" in plan for plan in plans)


def rows_shuffled(spark, work):
    """Rows written to shuffles by all stages of work."""
    context = spark.sparkContext._jsc.sc()
    kind = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().store().view(kind).iterator()
        found = {}
        while stages.hasNext():
            stage = stages.next().info()
            found[stage.stageId()] = stage.shuffleWriteRecords()
        return found

    before = written()
    work()
    return sum(rows for stage, rows in written().items() if stage not in before)


def test_members_and_vectors_of_a_bank_are_shuffled_once(spark, sf):
    """Without broadcasts, as with large tables: events by item twice, members by subject once, and the keys of two flags."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "-1")
        members = pooling.feature_modes(queries._flagged(spark, sf)).count()
        rows = rows_shuffled(spark, lambda: queries.QUERIES["feature_bank"](spark, sf).write.format("noop").mode("overwrite").save())
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < rows <= 3 * events + members
