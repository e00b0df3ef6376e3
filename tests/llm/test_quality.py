import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorframe.llm import quality

from .oracle import rows as rows_of
from .oracle import sql_rows


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force():
    r = random.Random(3)
    texts = ["", " \n\n ", "é\x85x\x1cy a\x0bb", "a b c d e f g h a b c d e f g h", "#*$%&|<> \n x\nx\n x\n"]
    texts += ["".join(r.choices(["a", "b", " ", "\n", "é", "#"], weights=[4, 4, 6, 2, 1, 1], k=r.randint(0, 400))) for _ in range(300)]
    for t in texts:
        assert quality.rules(t) == brute(t)


PROSE = " ".join(f"word{i}x" for i in range(40))


def test_frequent_lines_reject_depleted_documents(spark):
    line = "This very common banner line shows everywhere again"
    own = lambda i: " ".join(f"own{i}n{k}" for k in range(8))
    rows = [(i, f"{own(i)}\n" + f"{line}\n {line.upper()} \n{line.title()}\n", "a", "z") for i in range(30)]  # base rules pass, but little more than the banner
    rows += [(100 + i, f"{PROSE} {own(i)}\n{line}\nMenu", "a", "z") for i in range(10)]
    rows += [(400 + i, f"{line} {i}\n{PROSE} {i}", "a", "z") for i in range(30)]  # numbers tell lines apart
    rows += [(200, f"{line}\n{PROSE}\nunique words here " + line, "b", "z"), (300, None, None, "z"), (300, None, None, "z")]
    rows += [(500 + i, f"{PROSE} copied\nand again\nalways the same", "c", "z") for i in range(40)]  # one text, however often
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash string")
    got = quality.verdicts(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not any(by[i].base_failed or by[i].kept for i in range(30)) and by[0].n_lost_words == 24
    assert all(by[100 + i].kept and by[100 + i].n_lost_words == 9 for i in range(10))
    assert all(by[400 + i].kept and not by[400 + i].n_lost_words for i in range(30))
    assert not by[300].kept and by[300].base_failed and all(by[500 + i].kept and not by[500 + i].n_lost_words for i in range(40))
    assert by[200].n_lost_words == 0 and by[200].kept  # another host
    assert rows_of(quality.digests(docs)) == sql_rows(quality.ORACLE_SQL, documents=docs)
    assert quality.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("of,least", [(3, None), (4, 4), (50, 9), (500, 19), (100_000, 651)])
def test_the_limit_at_every_size(spark, of, least):
    found = spark.range(1, of + 1).filter(quality.above_limit(F.col("id"), F.lit(of))).agg(F.min("id")).first()[0]
    assert found == least


def test_clean_passes_any_columns_through(spark):
    banner = "a line that all of these documents share"
    rows = [(i % 7 or None, f"{PROSE} {i}\n{banner}", None, i, i, "x") for i in range(60)] + [(1, None, "s", 0, 0, "y"), (1, "", "s", 0, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, n_chars int, removed string").withColumnsRenamed({"removed": "tie"})
    docs = docs.withColumn("host", F.lit("h")).withColumn("kept", F.lit(1)).withColumn("_salt", F.lit(2)).withColumn("a.b", F.lit(3))
    out = quality.clean(docs.unionByName(docs.limit(3)).repartition(5))
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted({r._id for r in got}) == list(range(60)) and 60 <= len(got) <= 63
    assert all(r.text == f"{PROSE} {r._id}" and r.n_chars == len(r.text) and (r["_salt"], r["a.b"], r.kept, r.host, r.tie) == (2, 3, 1, "h", "x") for r in got)
    assert quality.clean(docs.limit(0)).count() == 0


def family(of, lines=10, changed=1, at=0, host="a"):
    """Near copies: ten lines each, some of them changed."""
    own = [f"line {k} of family {at} has its own words w{at}x{k} v{at}x{k}" for k in range(lines)]
    return [(at + i, "\n".join(f"changed {i} {k} in family {at} so other words here" if (k - i) % lines < changed else x for k, x in enumerate(own)), host) for i in range(of)]


@pytest.mark.parametrize("changed", [1, 2])
def test_a_family_of_near_copies_is_one_document(spark, changed):
    """Twenty near copies among 320 documents of a host: none of their lines is frequent, and all stay for the next stage."""
    banner = "Subscribe to our newsletter for more of this"
    rows = family(20, changed=changed) + [(1000 + i, f"{PROSE} {i}\n" + "\n".join(f"own {i} line {k} with words x{i}y{k}" for k in range(3)) + f"\n{banner}", "a") for i in range(300)]
    rows += family(5, at=5000, host=None) + [(9000, rows[0][1], "a"), (9001, rows[0][1].upper(), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert all(r.kept for r in got.values())
    assert all(got[i].n_lost_words == 0 for i in got if i < 1000 or i >= 5000) and all(got[1000 + i].n_lost_words == 8 for i in range(300))
    assert rows_of(quality.digests(docs)) == sql_rows(quality.ORACLE_SQL, documents=docs)


def test_bands_find_near_copies():
    r = random.Random(1)
    found = 0
    for _ in range(300):
        shared = [r.getrandbits(63) for _ in range(8)]
        a, b = (quality.bands_of(shared + [r.getrandbits(63) for _ in range(2)]) for _ in range(2))
        found += bool(set(a) & set(b))
    assert found >= 285 and quality.bands_of([5]) == quality.bands_of([]) == []
