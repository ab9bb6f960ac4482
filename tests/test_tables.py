import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from resona.operators import audit, kpi, report, star
from resona.operators.relevance import preprocess_comments
from resona.plans import metrics, skew
from resona.session import cut_lineage
from resona.plans.score import score_comments, score_text
from resona.sources import derived as D
from resona.sources import schemas, sink, threads, warehouse
from resona.streaming import ingest

PAGE = {
    "videoId": "v1",
    "items": [
        {"id": "a", "snippet": {"totalReplyCount": 2, "topLevelComment": {"snippet": {
            "textOriginal": "first", "publishedAt": "2024-01-02T03:04:05Z", "likeCount": 3}}},
         "replies": [{"id": "a.1", "snippet": {"textOriginal": "r1", "publishedAt": "bad", "likeCount": None}},
                     {"id": "a.2", "snippet": {"textOriginal": "buy it now, love it", "publishedAt": "2024-01-03", "likeCount": 1}}]},
        {"id": "b", "snippet": {"totalReplyCount": 0, "topLevelComment": {"snippet": {
            "textOriginal": "second", "publishedAt": "2024-01-02T03:04:05Z", "likeCount": 0}}},
         "replies": [{"id": "ghost", "snippet": {"textOriginal": "not read", "publishedAt": None, "likeCount": 0}}]},
        {"id": "c", "snippet": {"totalReplyCount": 1, "topLevelComment": {"snippet": {
            "textOriginal": "third", "publishedAt": None, "likeCount": 0}}}},
    ],
}


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.json").write_text(json.dumps(PAGE) + "\n" + json.dumps({"videoId": "v2", "items": []}))
    return str(tmp_path / "pages")


def test_threads_from_json(spark, landed):
    rows = {r["commentid"]: r for r in threads.flatten_threads(threads.read_threads(spark, landed)).collect()}
    assert set(rows) == {"a", "a.1", "a.2", "b", "c"}
    assert rows["a"]["commentpublishedat"] == datetime.date(2024, 1, 2)
    assert rows["a.1"]["commentpublishedat"] is None and rows["a.1"]["commentlikes"] == 0
    assert rows["a.2"]["videoid"] == "v1"


def test_video_records_from_json(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({
        "videoid": "v1", "title": "t", "publishedat": "2024-01-02T03:04:05Z", "duration": "PT5M",
        "viewcount": 0, "likecount": 3, "commentcount": 1, "topiccategory": ["x/wiki/Beauty"],
    }))
    row = star.prepare_videos(threads.read_videos(spark, str(tmp_path))).first()
    assert (row["engagement_rate"], row["contentduration_seconds"], row["topics"]) == (4.0, 300.0, ["Beauty"])
    assert row["publishedat"] == datetime.date(2024, 1, 2) and row["tags"] is None


def test_stream_scores_equal_batch_scores(spark, landed, tmp_path):
    scored = ingest.score_stream(ingest.read_thread_stream(spark, landed))
    query = ingest.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    batch = score_text(preprocess_comments(threads.flatten_threads(threads.read_threads(spark, landed))))
    stream = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))
    assert stream.count() == 5


def test_hot_keys_and_null_keys_join_like_any_other(spark):
    facts = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("commentid"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("videoid"),
    )
    dims = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(30)], "videoid string, x int")
    histogram = skew.key_histogram(facts, "videoid")
    hot = skew.hot_keys(histogram, "videoid", 100).collect()
    assert {(r["videoid"], r["_spread"]) for r in hot} == {("hot", 10)}
    stored = cut_lineage(histogram)
    for how in ("inner", "left"):
        plain = facts.join(dims, "videoid", how).select("commentid", "videoid", "x")
        for known in (None, stored):
            salted = skew.salted_join(facts, dims, "videoid", "commentid", how, rows_per_task=100, histogram=known)
            assert sorted(map(str, salted.select("commentid", "videoid", "x").collect())) == sorted(map(str, plain.collect()))
    usual = skew.salted_join(facts, dims, "videoid", "commentid", "left")
    assert sorted(map(str, usual.select("commentid", "videoid", "x").collect())) == sorted(map(str, plain.collect()))


def jobs_started(spark, run):
    """The number of jobs that `run` starts."""
    group = f"count-{run.__name__}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_twenty_thousand_hot_keys(spark):
    """Every key above the bound is split, however many there are, and nothing runs while the plan is made."""
    facts = spark.range(20_000 * 12).select(
        F.col("id").alias("commentid"), (F.col("id") % 20_000).alias("videoid")
    ).unionByName(spark.range(500).select((-F.col("id") - 1).alias("commentid"), F.lit(None).cast("long").alias("videoid")))
    dims = spark.range(15_000).select(F.col("id").alias("videoid"), (F.col("id") * 3).alias("x"))
    assert skew.hot_keys(skew.key_histogram(facts, "videoid"), "videoid", 10).count() == 20_000

    def plan():
        return skew.salted_join(facts, dims, "videoid", "commentid", "left", rows_per_task=10)

    assert jobs_started(spark, plan) == 0
    compared = plan().join(facts.join(dims, "videoid", "left").select("commentid", F.col("x").alias("y")), "commentid")
    assert compared.where("x <=> y").count() == compared.count() == 20_000 * 12 + 500


def test_star_keys_hold(spark, base):
    given = D.comments(spark, base).drop("weighted_relevance", "sentiment_label", "sentiment_score", "actionability_score", "cluster_label")
    scored = score_comments(given, D.videos(spark, base))
    tables = star.build_star(scored, star.prepare_videos(D.videos(spark, base)))
    assert set(tables) == set(schemas.WAREHOUSE)
    for name, df in tables.items():
        wanted = [c.split()[0] for c in schemas.WAREHOUSE[name].split(", ")]
        assert df.columns == wanted, name
        types = [f.dataType.simpleString() for f in df.schema.fields]
        assert types == [c.split()[1] for c in schemas.WAREHOUSE[name].split(", ")], name
        assert audit.pk_audit(df, schemas.PRIMARY_KEYS[name]).count() == 0, name
    orphans = audit.fk_audit([
        (f"{t}.{c}", tables[t], c, tables[p], pc) for t, c, p, pc in schemas.FOREIGN_KEYS
    ])
    assert orphans.count() == 0
    best = tables["fact_comments"].agg(F.max("product_resonance_score")).first()[0]
    assert 0 < best <= 1
    assert tables["dim_author"].count() == 0 and tables["fact_comments"].count() == 1000


def test_pk_audit_reports_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "c")], "k int, l string")
    assert {(r["k"], r["l"], r["n_rows"]) for r in audit.pk_audit(df, ["k", "l"]).collect()} == {(1, "a", 2), (None, "c", 1)}


def test_calendar(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1),), (datetime.date(2023, 12, 31),), (None,)], "d date")
    rows = {r["dateid"]: r for r in star.dim_date(df).collect()}
    assert set(rows) == {"20240101", "20231231"}
    assert rows["20240101"]["weekday"] == 0 and rows["20231231"]["weekday"] == 6
    assert rows["20240101"]["monthname"] == "January" and rows["20231231"]["quarter"] == 4


def days(spark, *rows):
    frame = spark.createDataFrame(rows, "commentid string, day string, score double")
    return frame.select("commentid", F.to_date("day").alias("commentpublishedat"), "score", F.lit("x").alias("text_cleaned"))


def published(spark, path):
    rows = sink.read_scored(spark, path).collect()
    return sorted((r["commentid"], str(r["commentpublishedat"]), r["score"]) for r in rows)


def test_repeated_and_later_runs_leave_one_copy(spark, tmp_path):
    path = str(tmp_path / "scored")
    with pytest.raises(ValueError, match="nothing was published"):
        sink.read_scored(spark, path)
    first = days(spark, ("a", "2024-01-01", 1.0), ("b", "2024-01-02", 2.0), ("c", None, 3.0))
    for _ in range(2):
        sink.write_scored(first, path, "7")
        assert published(spark, path) == [("a", "2024-01-01", 1.0), ("b", "2024-01-02", 2.0), ("c", "None", 3.0)]
    assert "text_cleaned" not in sink.read_scored(spark, path).columns
    sink.write_scored(days(spark, ("b", "2024-01-02", 9.0), ("c", None, 8.0), ("d", "2024-01-03", 4.0)), path, "8")
    both = [("a", "2024-01-01", 1.0), ("b", "2024-01-02", 9.0), ("c", "None", 8.0), ("d", "2024-01-03", 4.0)]
    assert published(spark, path) == both
    # the same run with other days: its earlier rows go
    sink.write_scored(days(spark, ("e", "2024-01-05", 5.0)), path, "8")
    assert published(spark, path) == [("a", "2024-01-01", 1.0), ("e", "2024-01-05", 5.0)]
    sink.write_scored(first.limit(0), path, "9")
    assert published(spark, path) == [("a", "2024-01-01", 1.0), ("e", "2024-01-05", 5.0)]
    assert all(any(d.name.startswith("commentpublishedat=") for d in a.iterdir())
               for a in list((tmp_path / "scored/data").iterdir())[:1])


def test_a_run_that_fails_half_way_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "scored")
    sink.write_scored(days(spark, ("a", "2024-01-01", 1.0)), path, "1")
    broken = days(spark, ("a", "2024-01-01", 2.0), ("b", "2024-01-02", 0.0)).withColumn(
        "score", F.when(F.col("score") == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        sink.write_scored(broken, path, "2")
    # days written, but never published
    days(spark, ("a", "2024-01-01", 7.0)).write.partitionBy("commentpublishedat").parquet(f"{path}/data/attempt=a-x")
    assert published(spark, path) == [("a", "2024-01-01", 1.0)]
    sink.write_scored(days(spark, ("a", "2024-01-01", 2.0)), path, "2")
    assert published(spark, path) == [("a", "2024-01-01", 2.0)]


def test_adhoc_sql_is_guarded(spark):
    with pytest.raises(ValueError, match="Only SELECT"):
        warehouse.adhoc_sql(spark, "SHOW TABLES", {})


def test_empty_tables_give_zero(spark):
    comments = spark.createDataFrame([], schemas.WAREHOUSE["fact_comments"])
    videos = spark.createDataFrame([], schemas.WAREHOUSE["dim_video"])
    for df in (kpi.kpi_avg_engagement(videos), kpi.kpi_total_videos(videos)):
        assert df.first()[0] == 0
    for metric in (kpi.kpi_avg_prs, kpi.kpi_quality_comment_ratio, kpi.kpi_spam_ratio,
                   kpi.kpi_comment_quality_pct, kpi.kpi_total_comments):
        assert metric(comments).first()[0] == 0
    assert report.report_counts(comments).first()["spam_ratio"] == 0
    assert report.page_metrics(comments).first()["nonspam_spam_ratio"] == "0 : 0"


def test_unknown_metric():
    assert metrics.fetch_metric("no such chart", None) is None
    assert len(metrics.METRICS) == 16


def test_the_catalogue_reads_the_comments_once(spark):
    rows = [(i % 5, i % 3, ["a", "b", None][i % 3], ["P", None][i % 2], 0.1 * (i % 10), i % 4 == 0, None if i % 7 == 0 else 0.1 * i)
            for i in range(60)] + [(None, 1, "a", "P", 0.9, True, 0.2)]
    comments = spark.createDataFrame(
        rows, "videoid long, dateid int, cluster_label string, sentiment_label string, sentiment_score double, is_spam boolean, "
        "product_resonance_score double")
    days, videos = metrics.fact_sums(comments)
    assert sum(r["n"] for r in days.collect()) == len(rows) and sum(r["n"] for r in videos.collect()) == len(rows) - 1
    shared = metrics._comment_metrics(days)
    star = metrics.Star(comments, None, None, None, None, None)
    for name, df in shared.items():
        one, other = (sorted(map(str, x.collect())) for x in (df, metrics.fetch_metric(name, star)))
        assert [re.sub(r"(\d\.\d{9})\d*", r"\1", x) for x in one] == [re.sub(r"(\d\.\d{9})\d*", r"\1", x) for x in other], name
    per = {(r["videoid"], r["cluster_label"]): (r["n"], r["n_prs"]) for r in kpi.per_video(comments).collect()}
    assert {(r["videoid"], r["cluster_label"]): (r["n"], r["n_prs"]) for r in videos.collect()} == per
    for df in (days, videos):
        assert "LocalTableScan" not in df._jdf.queryExecution().executedPlan().toString()


def test_page_percentages_round_half_to_even(spark):
    df = spark.createDataFrame([(i == 0, True, 0.5) for i in range(8)],
                               "is_spam boolean, is_relevant boolean, product_resonance_score double")
    assert report.page_metrics(df).first()["nonspam_spam_ratio"] == "88 : 12"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (None,)], "weighted_relevance double")
    counts = [r["count"] for r in report.relevance_histogram(df).orderBy("bin").collect()]
    assert counts == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    same = spark.createDataFrame([(2.0,), (2.0,)], "weighted_relevance double")
    rows = report.relevance_histogram(same).orderBy("bin").collect()
    assert rows[5]["count"] == 2 and rows[0]["bin_start"] == 1.5 and rows[9]["bin_end"] == 2.5


def test_sections(spark):
    text = "intro\n\n1. Audience Insights:\nthey like it\nour product is fine\nlost? no\n  CONTENT \nclip\nAudience\nmore"
    row = report.sectionize(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert row[0].asDict() == {
        "text": text, "executive_summary": "intro", "audience_insights": "they like it more",
        "product_analysis": "lost? no", "content_performance": "clip", "recommendations": "",
    }
    assert set(row[1][1:]) == {""}


def test_key_audit_counts_whole_numbers_as_they_are(spark):
    child = spark.createDataFrame([(1, "1", 1), (2, "x", 2), (2, None, 2), (None, "01", None)], "a long, b string, c int")
    parent = spark.createDataFrame([(1, 1), (1, None), (None, 3)], "k long, j int")
    found = audit.fk_audit([
        ("long", child, "a", parent, "k"), ("text", child, "b", parent, "k"), ("int", child, "c", parent, "k")])
    assert sorted(map(tuple, found.collect())) == [("int", "2", 2), ("long", "2", 2), ("text", "01", 1), ("text", "x", 1)]
    alike = audit.fk_audit([("long", child, "a", parent, "k")])._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(a" not in alike


def test_the_catalogue_lists_every_comment(spark, base):
    from resona.plans.registry import registry

    chart = "Chart: Engagement Rate VS Product Resonance Score"
    found = registry()["metric_catalogue"](spark, base).where(F.col("metric") == chart)
    counts = {r["measure"]: r["count"] for r in found.groupBy("measure").count().collect()}
    n = registry()["engagement_vs_prs"](spark, base).count()
    assert counts == {"engagement_rate": n, "product_resonance_score": n} and n
