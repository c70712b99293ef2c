import pytest

from locusforge.operators.quality import marker_counts
from locusforge.streaming.arrivals import counts_by_time, counts_of_stream, keep_counts, latest_counts


def test_counts_follow_arrivals(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "marker string, dosage int, at timestamp"
    first = spark.range(200).selectExpr("concat('m', id % 3) as marker", "cast(case when id % 7 = 0 then null else id % 3 end as int) as dosage", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as at")
    first.write.parquet(source)
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    for more in (None, first.limit(50)):
        if more is not None:
            more.write.mode("append").parquet(source)
        keep_counts(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        want = sorted(map(tuple, marker_counts(spark.read.schema(kind).parquet(source)).collect()))
        assert sorted(map(tuple, latest_counts(spark, str(tmp_path / "out")).collect())) == want
    with pytest.raises(ValueError):
        counts_of_stream(first)
    query = counts_by_time(stream(), time="at").writeStream.format("memory").queryName("by_time").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("by_time").where("n_samples > 0").count() > 3
