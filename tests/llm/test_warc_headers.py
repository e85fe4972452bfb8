"""WARC headers of any length, the count of records, and how reading is spread."""

import pytest
from pyspark.sql import functions as F

from skemara.llm import warc


@pytest.mark.parametrize("width", [1 << 16, 8 << 20])
def test_header_of_over_a_mebibyte(spark, width):
    urls = ["a", "http://e/" + "u" * (3 << 19) + "/WARC/1.1", "b", "c"]
    pages = spark.createDataFrame([(i, u, f"text {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    got = warc.warc_round_trip(pages, width).collect()
    assert sorted((r.page_id, r.url, r.intact) for r in got) == [(i, u, True) for i, u in enumerate(urls)]


def test_missing_records_fail_the_job(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, warc.scratch_dir(spark, "warc"))
    with pytest.raises(RuntimeError, match="records written and read differ"):
        warc.read_warc(spark, files.withColumn("records", F.col("records") + 1))


def test_reading_is_spread_over_tasks(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, warc.scratch_dir(spark, "warc"))
    assert warc.boundaries(spark, files, 4096).rdd.getNumPartitions() > 1
    assert warc.read_warc(spark, files, 4096).count() == 300


def test_attempts_have_files_of_their_own(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(9)], "page_id long, url string, html string")
    folder = warc.scratch_dir(spark, "warc")
    one, two = warc.write_warc(pages, folder), warc.write_warc(pages, folder)
    names = [{r.uri for r in f.collect()} for f in (one, two)]
    assert not names[0] & names[1]
    assert warc.read_warc(spark, one).count() == warc.read_warc(spark, two).count() == 9
