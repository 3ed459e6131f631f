from pagewarden.operators.checks import PAGE_CHECKS
from pagewarden.plans.scorecard import check_summary, page_results
from pagewarden.streaming.scores import PAGES, arriving_pages, keep_scores, keep_summary, latest_summary

CHECKS = tuple(c for c in PAGE_CHECKS if c.id in ("meta.title", "content.headings"))


def test_a_stream_scores_as_a_batch_does(spark, tmp_path):
    rows = [(i, f"https://s{i % 3}.example/{i}", f"<html><head><title>{'Title ' * i}</title></head><body><h1>One</h1></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    pages.filter("page_id < 6").write.parquet(f"{tmp_path}/in")
    stream = arriving_pages(spark, f"{tmp_path}/in", 1)
    keep_scores(stream, f"{tmp_path}/scores", f"{tmp_path}/a", CHECKS).awaitTermination()
    keep_summary(stream, f"{tmp_path}/sums", f"{tmp_path}/b", CHECKS).awaitTermination()
    pages.filter("page_id >= 6").write.mode("append").parquet(f"{tmp_path}/in")
    keep_scores(stream, f"{tmp_path}/scores", f"{tmp_path}/a", CHECKS).awaitTermination()
    keep_summary(stream, f"{tmp_path}/sums", f"{tmp_path}/b", CHECKS).awaitTermination()
    want = page_results(pages, CHECKS)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/scores").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    sums = check_summary(want)
    assert sorted(map(tuple, latest_summary(spark, f"{tmp_path}/sums").select(sums.columns).collect())) == sorted(map(tuple, sums.collect()))
