"""No task of a join reads most of the rows where most of the rows have one key."""

import pytest
from data import docs
from pyspark.sql import functions as F

from incidara.llm import components, near_copies, quality, simhash

PARTS = 32
SETTINGS = {
    "spark.sql.shuffle.partitions": str(PARTS),
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def skewed(spark, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_shares(spark, run, least=4000):
    """Of each stage that read at least ``least`` shuffled rows: the share that its largest task read."""
    context = spark.sparkContext
    context.setJobGroup(group := f"skew-{id(run)}", "")
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    store = context._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, shares = context.statusTracker(), {}
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 100_000)
            read = [m.get().shuffleReadMetrics().recordsRead() for k in range(tasks.size()) if (m := tasks.apply(k).taskMetrics()).isDefined()]
            if sum(read) >= least:
                shares[stage] = max(read) / sum(read)
    assert shares
    return shares


def test_component_with_one_centre(skewed):
    edges = skewed.range(12_000, numPartitions=PARTS).select(F.col("id") + 1, F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(F.lit(0)))
    assert max(largest_shares(skewed, lambda: components.connect(edges.toDF("a", "b")).write.format("noop").mode("overwrite").save()).values()) < 0.25


def hot_documents(spark):
    """Of 12,000 documents, 11,000 are of one host and have its footer; 6,000 of these are one text."""
    footer = F.lit("\nThe footer of the site is this line")
    own = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.when(F.col("id") < 6000, F.lit(0)).otherwise(F.col("id"))) for k in range(30)])
    host = F.when(F.col("id") < 11_000, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id") % 50))
    return spark.range(12_000, numPartitions=PARTS).select(F.col("id").alias("doc_id"), F.concat(own, footer).alias("text"), host.alias("source"))


@pytest.mark.parametrize("operator", [quality.judge, quality.clean])
def test_hot_text_and_hot_line(skewed, operator):
    table = hot_documents(skewed)
    assert operator(table).count() == 12_000
    shares = largest_shares(skewed, lambda: operator(table).write.format("noop").mode("overwrite").save())
    assert max(shares.values()) < 0.25


def test_one_component_of_fingerprints(skewed):
    words = " ".join(f"word{k}" for k in range(400))
    table = skewed.range(12_000, numPartitions=PARTS).select(F.col("id").alias("doc_id"), F.concat(F.lit(words), F.lit(" "), (F.col("id") % 3000).cast("string")).alias("text"))
    sizes = simhash.near_components(table).groupBy("component_id").count().agg(F.max("count")).first()[0]
    assert sizes > 6000  # most are one component
    assert max(largest_shares(skewed, lambda: simhash.near_components(table).write.format("noop").mode("overwrite").save()).values()) < 0.25


def test_one_group_of_near_copies(skewed, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 256)
    monkeypatch.setattr(near_copies, "TASK_ROWS", 1024)
    words = " ".join(f"word{k}" for k in range(60))
    texts = [(k, f"{words} own{k}") for k in range(3000)] + [(5000 + k, " ".join(f"o{k}n{j}" for j in range(30))) for k in range(300)]
    table = docs(skewed, texts).select("doc_id", "text").repartition(PARTS, "doc_id")
    shares = largest_shares(skewed, lambda: near_copies.near_groups(table).write.format("noop").mode("overwrite").save())
    assert max(shares.values()) < 0.25
