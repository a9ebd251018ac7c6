import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from noteloom.llm import warc
from noteloom.llm.warc import archive_round_trip, original_records, payload_store, read_warc, record_headers, write_warc


@pytest.fixture
def pages(spark):
    html = F.concat(F.lit("<p>"), F.expr("repeat(md5(cast(id % 40 AS string)), cast(id % 40 AS int) * 4)"))
    hot = F.when(F.col("id") % 3 == 0, F.expr("repeat('hot payload ', 200)")).otherwise(html)
    return spark.range(600).repartition(7).select(F.col("id").alias("page_id"), F.lit("http://e.org/").alias("url"), hot.alias("html"), F.lit(1).alias("payload"))


def test_revisits_get_the_bytes_of_the_response_they_name(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    files = write_warc(pages, folder)
    records = read_warc(spark, folder, files)
    store = payload_store(records, once_from=1000)
    assert store.count() == store.select("payload_sha256").distinct().count() == payload_store(records).count()
    html = {r.page_id: r.html for r in pages.collect()}
    whole = original_records(record_headers(records), store).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in whole} == html
    revisits = [r for r in whole if r.record_type == "revisit"]
    assert len(revisits) > 300 and all(html[r.refers_to] == html[r.page_id] for r in revisits)


def test_rows_rest_on_the_stored_bytes(spark, pages, monkeypatch):
    got = {r.page_id: r for r in archive_round_trip(pages).collect()}
    for r in pages.collect():
        data = r.html.encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    made = warc.payload_store
    monkeypatch.setattr(warc, "payload_store", lambda records, once_from=None: made(records, once_from).withColumn("payload", F.concat("payload", F.encode(F.lit("!"), "UTF-8"))))
    with pytest.raises(Exception, match="not the payload"):
        archive_round_trip(pages).collect()
    monkeypatch.setattr(warc, "payload_store", lambda records, once_from=None: made(records, once_from).limit(3))
    with pytest.raises(Exception, match="not the payload"):
        archive_round_trip(pages).collect()


def test_files_are_gzip_members(spark, pages, tmp_path):
    files = write_warc(pages.filter("page_id < 5"), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == 5
