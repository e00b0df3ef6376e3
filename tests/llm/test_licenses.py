import itertools
import math
import re
import time
from collections import Counter

from tensorframe.llm import licenses

from .oracle import rows, sql_rows


def brute(files):
    n = len(files)
    df = Counter(t for _, _, x in files for t in set(licenses.terms_of(x or "")))
    idf = lambda t: licenses.idf(df[t], n)
    vec = lambda x: {t: (1 + math.log(c)) * idf(t) for t, c in Counter(licenses.terms_of(x)).items()}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return round(sum(x * b.get(t, 0) for t, x in a.items()) / norm, 6) if norm else 0.0

    templates = [(vec(t), name) for name, t in licenses.TEMPLATES]

    def best(x):
        own = vec(x)
        found = [(-cosine(own, v), name) for v, name in templates]
        return min(found) if found and -min(found)[0] >= licenses.BAR else None

    def parts(x):
        lines = x.split("\n")
        comments = [list(g) for on, g in itertools.groupby(lines, lambda y: bool(re.match(r"[ \t]*(#|//|/\*|\*|--|;|%)", y))) if on]
        return {*lines, *re.split(r"\n(?:[ \t\r]*\n)+", x), *map("\n".join, comments)}

    own = {}
    for i, (_, path, x) in enumerate(files):
        lines = [b for part in parts(x or "") if (b := best(part))]
        own[i] = ("file", *best(x)) if x and best(x) else ("header", *min(lines)) if lines else None
    out = []
    for i, (doc, path, _) in enumerate(files):
        if own[i]:
            out.append((doc, own[i][2], own[i][0], -own[i][1], path))
            continue
        found = None
        d = path.rpartition("/")[0] if path and "/" in path else "" if path else None
        while d is not None and not found:
            holders = [(o[1], o[2], p) for (_, p, _), o in zip(files, own.values(), strict=True) if o and o[0] == "file" and p is not None and p.rpartition("/")[0] == d]
            found = min(holders) if holders else None
            d = None if d == "" else d.rpartition("/")[0]
        out.append((doc, found[1], "inherited", -found[0], found[2]) if found else (doc, None, "none", None, None))
    return sorted(out, key=repr)


FILES = [
    (0, "a/LICENSE", "Released under the MIT License."), (1, "a/b/c/x.py", "def f(): pass"), (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0"),
    (3, "a/b/c/y.py", "some prose\nThis work is licensed under the GNU General Public License, version 3.\nmore prose of the same"), (4, "z/w.txt", "nothing here"),
    (5, "top", None), (6, None, "orphan"), (7, "a/b/COPYING", "Licensed under CC BY-NC 4.0."), (8, "a/d/e", ""), (8, "a/d/e", ""), (9, "q/x", "license " * 3000), (10, "a/bb/x", "of the and to this is\nof the"),
    (11, "a//x", "plain"), (13, "lib/LICENSE", dict(licenses.TEXTS)["MIT"].replace("<year>", "2024").replace("<copyright holders>", "A. Body")), (14, "lib/src/a.c", "int a;"),
    (15, "gpl/COPYING", "Preface of one line\n\n" + dict(licenses.TEXTS)["GPL-3.0"]), (16, "gpl/x/y/z.c", "int b;"),
    (17, "w/wrapped.c", "int c;\n// Licensed under the Apache\n//   License, Version\n// 2.0 (the License); you may\n// not use this file except in\n// compliance with it.\nint d;"),
    (18, "w/para.txt", "Some words first.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction.\n \t\n\nLast words."), (12, "r/s/t", "intro\nLicensed under the Apache License, Version 2.0\nReleased under the MIT License"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(FILES, "doc_id long, path string, text string").selectExpr("*", "'x' as kind", "1 as unit", "2 as key", "3 as score", "4 as _near", "5 as `a.b`")
    got = licenses.scan(docs.repartition(3)).select("doc_id", "license", "license_kind", "license_score", "license_from").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(FILES)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_query_paths(spark):
    docs = spark.createDataFrame([(1, "x", None, "s"), (2, "Released under the MIT License.", "en", None), (3, "own", "en", None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in licenses.digests(docs).collect()}
    assert got[1].path == "s//1" and got[3].license == "MIT" and got[3].license_kind == "inherited"
    assert rows(licenses.digests(docs)) == sql_rows(licenses.oracle_sql(), documents=docs)


def test_stock_texts_are_license_files(spark):
    prose = [(100 + i, f"p/{i}", f"the story of the {i}th day and of what was said in it, for any person or group " * 20) for i in range(40)]
    files = [(i, f"{name}/LICENSE", text) for i, (name, text) in enumerate(licenses.TEXTS)] + prose
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert all((got[i].license, got[i].license_kind) == (name, "file") for i, (name, _) in enumerate(licenses.TEXTS))
    assert all(got[i].license_kind == "none" for i, *_ in prose)


def test_many_distinct_terms_take_linear_time(spark):
    notice = "Released under the MIT License\n"
    docs = lambda n: spark.createDataFrame([(1, "a/b", notice + " ".join(f"term{i}" for i in range(n)))], "doc_id long, path string, text string")
    took = []
    for n in (2_000, 64_000):
        t = time.perf_counter()
        assert licenses.scan(docs(n)).first().license == "MIT"
        took.append(time.perf_counter() - t)
    assert took[1] < 6 * took[0] + 5


def test_one_ordinary_word_more_at_any_size(spark):
    """A frequent word beside the notice weighs little, however many files there are."""
    for n in (50, 2000):
        files = [(i, f"{i}/x", f"this is a file, see it {i}") for i in range(n)] + [(-1, "z/x", "Released under the MIT License, see file")]
        assert licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).filter("doc_id = -1").first().license == "MIT"


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame(FILES[:4], "doc_id long, path string, text string").selectExpr("*", "'own' as license", "1 as license_score", "2 as license_from")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "path", "license", "license_kind", "license_score", "license_from"]
    assert sorted((tuple(r) for r in got.select("doc_id", "license", "license_kind", "license_score", "license_from").collect()), key=repr) == brute(FILES[:4])
    assert licenses.scan(docs.select("path", "text", "license")).filter("license = 'MIT'").count() > 0
