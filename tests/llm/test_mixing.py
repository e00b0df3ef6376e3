import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tensorframe.llm import mixing

from .oracle import rows, sql_rows


def documents(spark, n=300):
    r = random.Random(5)
    data = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "b", "b", "é", "\U0001f600", "～", None]), i) for i in range(n)]
    data += [(7, "one two", "a", 0), (7, "one two", "a", 0), (None, "three", "b", 0), (500, None, "c", 0), (501, "\x85 \x1c", "d", 0), (502, "w " * 50_000, "big", 0)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size int")


def test_equals_sql_and_reruns_agree(spark):
    docs = documents(spark)
    got = rows(mixing.digests(docs))
    assert got == sql_rows(mixing.ORACLE_SQL, documents=docs) == rows(mixing.digests(docs.repartition(9)))
    places = sorted(int(x) for r in mixing.digests(docs).collect() for x in r.places.split(",") if x)
    assert places == list(range(len(places))) and len(places) > 300


def test_targets_are_met_and_bounded(spark):
    got = mixing.mix(documents(spark)).collect()
    total = sum(r.size for r in got)
    aims = {(r.source, r.source_size, r.target) for r in got}
    assert abs(sum(a[2] for a in aims) - total) < 1e-6 * total
    for source, size, target in aims:
        taken = sum(r.taken for r in got if r.source == source)
        assert target <= 3 * size + 1e-9 and taken <= target + 1e-9
        assert target - taken <= min([r.size for r in got if r.source == source and r.size] or [0])
    assert all(r.taken <= 3 * r.size and len(r.positions) == r.times and all(0 <= p <= 1 for p in r.positions) for r in got)


def test_train_order(spark):
    docs = documents(spark)
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += r.times
    out = mixing.train_order(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +times
    # In the order of the places that the query gives.
    place = {int(x): r.doc_id for r in mixing.digests(docs).collect() for x in r.places.split(",") if x}
    assert [r.doc_id for r in got] == [place[i] for i in range(len(got))]
    assert mixing.train_order(docs.limit(0)).count() == 0 == mixing.digests(docs.limit(0)).count()


def test_columns_of_any_name_and_null_ids(spark):
    data = [(None, f"text {i} " * 9, "s", i, -i, "a") for i in range(40)] + [(None, "text 1 " * 9, "s", 1, -1, "a"), (3, None, None, 90, -90, "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _id int, rid int, h string").withColumns({"_n": F.lit(1), "_position": F.lit(2), "place": F.lit(3), "shard": F.lit(4), "a.b": F.lit(5)})
    got = mixing.train_order(docs, most=1).collect()
    assert Counter(r._id for r in got) == Counter(r[3] for r in data[:-1])
    assert all((r.rid, r._n, r._position, r.place, r.shard, r["a.b"], r.text) == (-r._id, 1, 2, 3, 4, 5, f"text {r._id} " * 9) for r in got)


def test_the_last_pass_takes_all_that_fits(spark):
    first = min(range(61), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    data = [(i, "w " * (10_000 if i == first else 10), "a") for i in range(61)] + [(100 + i, "w " * 50, "b") for i in range(100)]
    # All fit but the first document, which alone is beyond the target.
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[first].times == 0 and all(got[i].times == 1 for i in range(61) if i != first)
    assert len({got[i].positions[0] for i in range(61) if i != first}) == 60
    # Nothing that is left over fits what a source misses.
    rows_of = mixing.mix(documents(spark)).collect()
    for source in {r.source for r in rows_of}:
        of = [r for r in rows_of if r.source == source and r.size]
        if not of:
            continue
        gap = of[0].target - sum(r.taken for r in of)
        full = int(of[0].target // of[0].source_size)
        assert gap >= -1e-9 and all(r.size > gap for r in of if r.times == full)
