import random
from collections import Counter

from pyspark.sql import functions as F

from tensorframe.llm import fingerprints

from .oracle import rows, sql_rows


def documents(spark, n=60):
    r = random.Random(5)
    texts = ["".join(r.choices(["word ", "é", ". ", "\n", "\n\n", "!?", "x" * 30], k=r.randint(0, 40))) for _ in range(n)]
    data = [(3 * i, t, "x") for i, t in enumerate(texts)]
    data += [(6, texts[2], "x"), (9, "tie", "y"), (None, "no id", "z"), (1, None, "x"), (2, "", "x"), (1000, "long " * 20_000, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, fingerprint string")


def test_equals_sql(spark):
    docs = documents(spark).repartition(5)
    assert rows(fingerprints.edits(docs)) == sql_rows(fingerprints.ORACLE_SQL, documents=docs)


def test_one_row_and_empty(spark):
    docs = documents(spark)
    one = docs.filter("doc_id = 1000")
    assert rows(fingerprints.edits(one)) == sql_rows(fingerprints.ORACLE_SQL, documents=one)
    assert fingerprints.edits(docs.limit(0)).count() == 0


def test_ids_that_fill_many_ranges(spark):
    r = random.Random(3)
    data = [(r.choice([None, None, 7, 7, 7, i, -i]), f"text {r.randint(0, 60)} of these. " * r.randint(0, 3), "x") for i in range(400)]
    docs = spark.createDataFrame([*data, (7, None, "x"), (2**62, "far", "x"), (-(2**62), "off", "x")], "doc_id long, text string, at string").repartition(5)
    assert rows(fingerprints.edits(docs)) == sql_rows(fingerprints.ORACLE_SQL, documents=docs)
    # Null and 7 don't stay in one range each.
    keyed = docs.select(F.coalesce("doc_id", F.lit(fingerprints.LEAST)).alias("key"))
    starts = Counter(c[:16] for c in fingerprints._cuts(keyed, 16))
    assert sorted(starts.values())[-2] >= 3


def test_a_fingerprint_is_smaller_than_its_text(spark):
    docs = documents(spark).withColumn("text", F.repeat(F.coalesce("text", F.lit("")), 20))
    done = fingerprints.fingerprint(docs, leaves="leaves").agg(F.sum(F.length("fingerprint")).alias("a"), F.sum(F.length("text")).alias("b"), F.max(F.size("leaves")).alias("c")).first()
    assert done.a < done.b / 2 and done.c > 5


def brute_differs(a, b):
    """Branches of a by descent, from the texts."""

    def apart(x, y):
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head + 1, len(x) - tail

    if a == b:
        return ""
    x, y = ([s.split("\n") for s in t.split("\n\n")] for t in (a, b))
    (first, last), (_, other) = apart(x, y), apart(y, x)
    return ",".join(f"{i}.{'-'.join(map(str, apart(x[i - 1], y[i - 1])))}" if i <= other else str(i) for i in range(first, last + 1))


def test_differing_branches(spark):
    base = "\n\n".join(f"Section {i} says this. And that.\nMore of {i}.\nThe end of {i}." for i in range(6))
    others = [
        base, base.replace("More of 3", "Less of 3"), base.replace("More of 3.\n", ""), base.replace("More of 3", "New line\nMore of 3"), base + "\n\nOne section more", "Before\n\n" + base, base.replace("of 1", "1").replace("of 4", "4"), "",
        "\n\n".join(base.split("\n\n")[::-1]), base[:-40], base.replace("\n\nSection 2", "\nSection 2"), base * 2,
    ]
    r = random.Random(2)
    pairs = [(base, x) for x in others] + [tuple("".join(r.choices(["a", "b", "\n", "\n\n"], k=r.randint(0, 14))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for c in "ab":
        df = fingerprints.fingerprint(df, c, f"f{c}")
    got = df.select("a", "b", F.array_join(fingerprints.differing(F.col("fa"), F.col("fb")), ",").alias("ab"), F.array_join(fingerprints.differing(F.col("fb"), F.col("fa")), ",").alias("ba")).collect()
    for x in got:
        assert (x.ab, x.ba) == (brute_differs(x.a, x.b), brute_differs(x.b, x.a)), x
    assert [x.ab for x in got[:6]] == ["", "4.2-2", "4.2-2", "4.2-1", "", ""] and [x.ba for x in got[3:6]] == ["4.2-2", "7", "1"]
