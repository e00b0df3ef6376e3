import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorframe.llm import warc

from .oracle import rows, sql_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def pages(spark):
    r = random.Random(2)
    long = ["<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200, "b" * 1000, "é" * 500]
    data = [(i, r.choice(["http://a.b/x", "https://www.z.org:443/y?q=1", "http://c.d/ e\r\nf", None, "http://[bad/"]), r.choice([*long, "short", "c" * 999, "", None, f"own {i} " * 300])) for i in range(200)]
    data += [(5, "http://a.b/x", "twice"), (5, "http://a.b/x", "twice"), (None, None, "b" * 1000), (None, "u", "only" * 400)]
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'x' as run")


def test_equals_sql(spark):
    p = pages(spark).repartition(6)
    assert rows(warc.digests(p)) == sql_rows(warc.ORACLE_SQL, pages=p)
    assert warc.digests(p.limit(0)).count() == 0


def test_global_order(spark):
    got = warc.archive(pages(spark).repartition(5)).collect()
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == 204
    assert "org,z)/y?q=1" in {k[0] for k in keys}


def test_places_fetch_records(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write(pages(spark).repartition(3), path, archive_bytes=2000)
    found = warc.read(spark, path).collect()
    assert len(found) == 204 and len({r.run for r in found}) > 6
    for r in found:
        archive = Path(path, r.run).read_bytes()
        fields, block = warc.record_at(archive, r.offset, r.length)
        assert fields["warc-record-id"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
        if r.record_type == "response":
            assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest
    # A run is an archive that any reader of gzip unpacks, record after record.
    whole = Path(path, found[0].run).read_bytes()
    assert len(list(warc.parse(io.BytesIO(gzip.decompress(whole))))) == sum(r.run == found[0].run for r in found)


def test_long_records_are_split_into_members():
    record = b"WARC/1.1\r\nContent-Length: 5000\r\n\r\n" + b"x\r\n\r\n" * 1000 + warc.END.encode()
    short = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n" + warc.END.encode()
    packed = warc.members(record, 700)
    assert len(packed) > 5 and all(m[-1] == 0 for m in packed)
    archive = b"".join([*warc.members(short), *packed, *warc.members(short)])
    for step in (1, 7, 100_000):
        got = list(warc.unpacked(archive, step))
        assert [len(x[3]) for x in got] == [0, 5000, 0] and got[-1][0] + got[-1][1] == len(archive)
    with pytest.raises(ValueError):
        list(warc.unpacked(archive[:-3]))


def test_more_ranges_than_partitions(spark):
    path = warc.scratch_path(spark, "warc")
    warc.write(pages(spark), path)
    got = warc.merge_runs(warc.materialize(warc.read(spark, path), "captures"), range_rows=10).collect()
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == 204


def test_captures_of_one_key_fill_several_ranges(spark):
    """Rows without url and page are one key: their ranges are cut by run and place, and all come out in order."""
    docs = spark.createDataFrame([(None, None, f"page {i}") for i in range(300)] + [(i, f"http://a.org/{i}", "x") for i in range(20)], "page_id long, url string, html string").repartition(4)
    path = warc.scratch_path(spark, "warc")
    warc.write(docs, path, archive_bytes=4000)
    captures = warc.materialize(warc.read(spark, path), "captures")
    merged = warc.merge_runs(captures, range_rows=20)
    got = merged.collect()
    assert [warc._order(tuple(r)) for r in got] == sorted(warc._order(tuple(r)) for r in captures.collect()) and len(got) == 320
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in merged.withColumn("part", warc.F.spark_partition_id()).groupBy("part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 80
