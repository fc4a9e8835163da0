import base64
import gzip
import hashlib
import io
import random
from glob import glob

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hookloom.llm import warc
from hookloom.session import shared_dir
from tests.llm.edges import no_pages, pages


def brute(rows):
    digests = [base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode() for _, html in rows]
    first, count = {}, {}
    for (page, _), digest in zip(rows, digests):
        count[digest] = count.get(digest, 0) + 1
        if page is not None:
            first[digest] = min(first.get(digest, page), page)
    out = []
    for (page, html), digest in zip(rows, digests):
        again = count[digest] > 1 and digest in first and page != first[digest]
        out.append((page, len((html or "").encode()), digest, "revisit" if again else "response", first[digest] if again else None))
    return sorted(out, key=repr)


def test_round_trip_and_order(spark, monkeypatch):
    own = [("http://www.b.org/x?q=1#f", "<p>é</p>"), ("http://a.org/\r\nX: y", "same"), ("http://c.a.org/", "same")]
    table = pages(spark, *own, *((f"http://h{i % 7}.org/{i}", f"body {i % 30}") for i in range(90)))
    rows = warc.warc_report(table).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == brute([(r["page_id"], r["html"]) for r in table.collect()])
    rows.sort(key=lambda r: (r["index_range"], r["index_place"]))
    keys = [(r["url_key"], r["captured_at"]) for r in rows]
    assert keys == sorted(keys)
    assert "org,b)/x?q=1" in {r["url_key"] for r in rows}


def test_many_runs_are_merged_in_rounds_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    table = pages(spark, *((f"http://h{i % 5}.org/{i % 11}", f"body {i}") for i in range(120))).repartition(10)
    folder = f"{shared_dir(spark)}/warc-{random.getrandbits(60)}"
    archives = warc.write_archives(table, folder, archive_bytes=2000)
    assert archives.count() > 10
    monkeypatch.setattr(warc, "RUN_ROWS", 5)
    runs = warc.index_archives(archives, folder)
    rows = warc.merged_captures(runs, folder).collect()
    assert len(rows) == table.count() and len({r["index_range"] for r in rows}) > 3
    # Runs hold a few entries each, and no file of a merge round more than about a range.
    assert runs.agg({"rows": "max"}).first()[0] <= 5 and runs.agg({"rows": "sum"}).first()[0] == len(rows)
    merged = glob(f"{folder.removeprefix('file:')}/merged-*.run.parquet")
    sizes = {path: pq.read_metadata(path).num_rows for path in merged}
    assert len({path.split("-")[-3] for path in merged}) > 1 and 0 < max(sizes.values()) <= 3 * 20
    rows.sort(key=lambda r: (r["index_range"], r["index_place"]))
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    one = rows[5]
    with open(one["archive"].removeprefix("file:"), "rb") as source:
        source.seek(one["offset"])
        record = gzip.decompress(source.read(one["length"]))
    assert f"WARC-Page-ID: {one['page_id']}\r\n".encode() in record


def test_empty_table(spark):
    assert warc.warc_report(no_pages(spark)).collect() == []


def test_damaged_archives_fail():
    record = warc.warc_record(1, "http://a.org/", "2024-01-01T00:00:00Z", b"payload", None, False)
    warc.index_entry(record, "a", 0, 1)
    with pytest.raises(ValueError):
        warc.index_entry(record.replace(b"payload", b"paylaod"), "a", 0, 1)
    with pytest.raises(ValueError):
        list(warc.gzip_members(io.BytesIO(gzip.compress(record)[:-9])))


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(sorted(run)) for run in runs], lambda x: x)) == sorted(sum(runs, []))


def test_members_across_chunks():
    parts = [bytes([i]) * (i * 37) for i in range(1, 30)]
    packed = b"".join(gzip.compress(part) for part in parts)
    got = list(warc.gzip_members(io.BytesIO(packed), chunk=50))
    assert [content for _, _, content in got] == parts
    assert [gzip.decompress(packed[at:at + size]) for at, size, _ in got] == parts
