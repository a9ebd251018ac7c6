import gzip
import hashlib
import io

import pytest

from noteloom.llm.warc import archive_round_trip, original_records, parse_records, payload_store, read_warc, record_headers, write_warc

BIG, OTHER = "<p>é" + "x" * 1200, "<p>" + "y" * 998


@pytest.fixture
def pages(spark):
    html = [BIG, "small", BIG, None, "", "small", OTHER + "z", BIG, OTHER + "z", "line\r\n\r\nbreaks " * 100, "q" * 999, "q" * 999, "é" * 500, "é" * 500]
    rows = [(i, f"http://e.org/{i}?a=é b\r\nX: y", h, "z") for i, h in enumerate(html)] + [(7, None, BIG, "z"), (7, None, BIG, "z"), (None, "u", BIG, "z"), (None, "u", "tiny", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, uid string")


def expected(rows):
    groups = {}
    for i, (page_id, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((page_id is not None, page_id or 0, i))
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        out.append([page_id, len(data), hashlib.sha1(data).hexdigest()])
    for html, members in groups.items():
        if len(html.encode()) >= 1000 and len(members) > 1:
            best = max(members)[1]
            first = True
            for _, page_id, i in sorted(members, reverse=True):
                out[i] += ["response", None] if first else ["revisit", best]
                first = False
        else:
            for m in members:
                out[m[2]] += ["response", None]
    return sorted(map(str, out))


def test_round_trip(pages):
    got = archive_round_trip(pages).collect()
    assert sorted(str([*r]) for r in got) == expected([(r.page_id, r.html) for r in pages.collect()])
    assert archive_round_trip(pages.limit(0)).collect() == []


def test_store_and_reconstruction(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    files = write_warc(pages, folder)
    records = read_warc(spark, folder, files)
    store = payload_store(records)
    assert store.count() == len({r.html or "" for r in pages.collect()})
    whole = original_records(record_headers(records), store).collect()
    assert sorted(bytes(r.payload).decode() for r in whole) == sorted(r.html or "" for r in pages.collect())
    raw = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in files)
    parsed = list(parse_records(io.BytesIO(raw)))
    assert len(parsed) == pages.count() and {bytes(r.header) for r in whole} == {h for h, _, _ in parsed}


def test_damage_is_found(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    files = write_warc(pages.filter("page_id = 6"), folder)
    path = tmp_path / "w" / files[0]
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"yyyz", b"yyyx")))
    with pytest.raises(Exception, match="match its digest"):
        read_warc(spark, folder, files).collect()
