"""Plans: what is shuffled, pruned, pushed and kept on the JVM."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from vozmill.operators import aggregates, classify, dedupe, ordering, report
from vozmill.plans import dashboard
from vozmill.plans.normalize import normalize_feedback

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored analyzed table, as reports read it."""
    path = str(tmp_path_factory.mktemp("stored") / "analyzed")
    entry_module.queries()["rules_classify"](spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_rules_stay_on_the_jvm_without_shuffle(stored):
    plan = plan_of(classify.classify_rules(stored))
    assert "Python" not in plan and "Exchange" not in plan


def test_text_is_searched_once_per_keyword(stored):
    plan = plan_of(classify.classify_labels(stored).select("primary_theme", "priority"))
    assert plan.count("Contains(_lower") < 120
    assert plan.count("lower(raw_text") <= 2


def test_generated_methods_stay_small_enough_for_the_compiler(stored):
    query = classify.classify_rules(stored)._jdf.queryExecution()
    stages = query.debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_dedupe_prunes_before_its_only_exchange(stored):
    plan = plan_of(dedupe.dedupe_url(stored))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("WindowGroupLimit") == 2


def test_upsert_needs_one_exchange(stored):
    plan = plan_of(dedupe.upsert_feedback(stored, stored.withColumn("batch_seq", F.lit(9))))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max_by" in plan


def test_clean_upsert_does_not_shuffle_a_large_stored_table(stored):
    incoming = stored.sparkSession.createDataFrame(stored.limit(5).collect(), stored.schema)
    kept = dedupe.upsert_into_clean(stored, incoming)
    kept.collect()
    upper = plan_of(kept).split("Final Plan")[-1].split("Initial Plan")[0].split("LeftAnti")[0]
    assert "LeftAnti" in plan_of(kept) and "Exchange" not in upper


def test_top_themes_are_counted_once(stored):
    plan = plan_of(aggregates.theme_top_other(stored))
    assert plan.count("Scan parquet") == 1


def test_aggregates_read_only_their_columns(stored):
    plan = plan_of(aggregates.theme_priority_cross(stored))
    assert "ReadSchema: struct<primary_theme:string,priority:int>" in plan
    plan = plan_of(aggregates.report_numbers(stored))
    assert "raw_text" not in plan.split("ReadSchema")[1]


def test_filters_reach_the_scan(stored):
    plan = plan_of(ordering.priority_actions(stored))
    assert "GreaterThanOrEqual(priority,4)" in plan and "TakeOrderedAndProject" in plan


def test_samples_are_pruned_before_the_exchange(stored):
    assert plan_of(ordering.text_samples(stored)).count("WindowGroupLimit") == 2


def test_case_numbers_need_no_global_sort_of_the_cases(stored):
    plan = plan_of(ordering.critical_cases(stored))
    single = plan.count("Exchange SinglePartition")
    assert single == 1  # only the (priority, date, source) totals meet in one task


def test_the_dashboard_needs_one_scan(stored):
    numbers = dashboard.selection_numbers(stored, sentiments=["Negativo"])
    for df in (numbers, aggregates.kpis_of(numbers), aggregates.filter_options_of(numbers), aggregates.theme_distribution_of(numbers)):
        plan = plan_of(df)
        assert plan.count("Scan parquet") == 1 and "raw_text" not in plan.split("ReadSchema")[1]


def test_the_report_needs_two_scans(stored):
    plan = plan_of(report.report_lines(stored))
    assert plan.count("Scan parquet") == 2
    assert plan_of(ordering.report_lists(stored)).count("WindowGroupLimit") == 2


def test_priorities_reach_the_scan_of_a_stored_table(stored):
    plan = plan_of(aggregates.theme_priority_cross(stored, at_rest=True))
    assert "GreaterThan(priority,0)" in plan
    plain = aggregates.theme_priority_cross(stored).collect()
    assert sorted(map(str, plain)) == sorted(map(str, aggregates.theme_priority_cross(stored, at_rest=True).collect()))


def test_no_cartesian_products(spark, stored):
    for name, df in {
        "kpis": aggregates.kpis(stored),
        "theme_top_other": aggregates.theme_top_other(stored),
        "normalize": normalize_feedback(stored, "2024-12-31 00:00:00"),
        "critical": ordering.critical_cases(stored),
    }.items():
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_a_hot_id_is_split_over_tasks_in_the_reply_join(spark):
    """A third of the feedback shares one id; the join must split its partition."""
    old = {}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in settings.items():
        old[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        ident = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id")))
        feedback = spark.range(0, 60_000, 1, 8).select(
            ident.alias("feedback_id"), F.lit("Ana").alias("author"),
            F.concat(F.lit("Atraso na entrega "), F.sha2(F.col("id").cast("string"), 512)).alias("raw_text"),
        )
        replies = spark.range(0, 20_000, 1, 8).select(
            ident.alias("feedback_id"), F.lit('{"sentimento":"positivo"}').alias("reply"),
            F.col("id").alias("reply_seq"),
        )
        done = classify.enrich(feedback, replies)
        assert done.groupBy("provider").count().count() == 2
        rows = done.select("feedback_id", "provider", "raw_text")
        assert len(rows.collect()) == 60_000
        plan = plan_of(rows)
        assert "skewed" in plan or "skew=true" in plan
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
