"""Pages extracted as a stream equal pages extracted in one batch."""

import uuid

from pyspark.sql import functions as F

from sitequarry.functions.urls import hostname
from sitequarry.operators.admission import identify_pages
from sitequarry.operators.extract import extract
from sitequarry.streaming.extraction import start_extraction

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    pages = spark.read.parquet(PAGES).withColumn("site", hostname(F.col("url")))
    name, source, target = uuid.uuid4().hex, str(tmp_path / "in"), str(tmp_path / "out")
    for part in (pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(pages.schema).parquet(source)
        start_extraction(stream, target, name).awaitTermination()
    bad = spark.createDataFrame([(-1, "no url", "<p>x</p>", None)], pages.schema)
    bad.write.mode("append").parquet(source)
    start_extraction(stream, target, name).awaitTermination()
    batch = extract(identify_pages(pages))
    streamed = spark.read.parquet(target).select(batch.columns)
    (refused,) = streamed.filter("skip_reason = 'invalid url'").collect()
    assert refused.url == refused.captured_url == "no url" and refused.markdown == ""
    streamed = streamed.filter("page_id >= 0")
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))
