"""Quality rules by cross-document line frequency.

Each text gives counts (words, symbols, repeated lines and word windows) and a
verdict of its own.  Across documents, lines are normalised and hashed; the
distinct documents of each host that hold a line are counted; lines above the
limit are removed; a document that loses too large a share of its words is
rejected.  Documents of one text are one document to the counts, and so are near
copies, which share ALIKE of the words of their lines or more: else a family of
copies would make its own lines frequent, and none of it would be left.  Near
copies of a host are found by BANDS bands of MinHash values of their lines, each
document of a band is compared with the band's first, and linked documents make a
class; a pair at ALIKE is missed by all bands with a chance of 2 %, and may be
found by way of others.

A line is above the limit where so many of its host's documents hold it that, if
a share of SHARE of them did, the chance of it would be below CHANCE by
Chernoff's bound: n documents of N with n ln(p / s) + (N - n) ln((1 - p) / (1 - s))
>= ln(1 / CHANCE), p = n / N > s.  The rule has no floor and is one at every
size: of 50 documents nine must hold a line, of 500 nineteen, of many 0.5 %.

Defined cases: a null text has no words and fails; a null host is a host of its
own; repeated rows and doc_ids have verdicts of their own; an empty table gives
an empty result; other columns are ignored, and passed through by clean(),
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe.llm.common import WORD, materialize, null_key, slices, spread_join, tidy
from tensorframe.llm.graph import components

SYMBOLS = "#*$%&|<>"
SPAN = 8
MIN_WORDS = 20
SHARE = 0.005
CHANCE = 1e-9
MOST_LOST = 0.7
#: Near copies, for the counts: the share of words in common lines, and the bands of MinHash values that find them.
ALIKE = 0.65
BANDS, BAND = 12, 3

RULES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of span (a power of two) words that occur twice or more.

    Windows get exact ranks by doubling: the rank of 2k words is that of the
    pair of ranks of its halves, so no hash can collide.
    """
    n = len(words)
    if n <= span:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    most, width = len(ids), 1
    while width < span:
        pair = rank[:-width] * most + rank[width:]
        distinct, rank = np.unique(pair, return_inverse=True)
        most = len(distinct)
        if most == len(pair):  # no two alike, so no wider two either
            return 0
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(twice)] += twice
    edge[span : span + len(twice)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


_not_symbol = bytes(c for c in range(256) if c not in SYMBOLS.encode())
_spaces = str.maketrans("", "", "\x20\t\n\x0b\x0c\r")


def rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text.translate(_spaces)), len(raw.translate(None, _not_symbol)), dup, repeated_words(words)


def normalised(line: bytes) -> bytes:
    """Case (of ASCII letters) and spacing don't tell lines apart; numbers do, or the rows of any table would be alike."""
    return b" ".join(line.lower().split())


def lines_of(text: str) -> dict[int, int]:
    """Words by hash of the normalised line, for each line that has a word."""
    out: dict[int, int] = {}
    for line in text.encode().split(b"\n"):
        if n := len(line.split()):
            h = xxhash.xxh3_64_intdigest(normalised(line))
            h -= (h >> 63) << 64
            out[h] = out.get(h, 0) + n
    return out


_odd = np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_plus = np.random.default_rng(8).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)


def bands_of(hashes: list[int]) -> list[int]:
    """A key for each band of a set of lines; sets of one line have none, as copies of such a text have nothing else."""
    if len(hashes) < 2:
        return []
    h = np.array(hashes, np.int64).view(np.uint64)[:, None]
    with np.errstate(over="ignore"):
        x = h * _odd + _plus
        x ^= x >> np.uint64(29)
        least = (x * _odd).min(axis=0).reshape(BANDS, BAND)
        key = least[:, 0]
        for k in range(1, BAND):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + least[:, k]
        key = key ^ np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64).tolist()


def near_copies(texts: DataFrame) -> DataFrame:
    """(rid, root): the class, by its smallest rid, of each of the distinct texts (host, rid, hashes, words, bands) that has near copies in its host."""
    banded = texts.withColumn("band", F.explode("bands")).select("host", "band", "rid")
    firsts = banded.groupBy("host", "band").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = spread_join(banded, firsts, ["host", "band"]).filter("rid <> first").select("rid", "first").distinct()
    lines = texts.select("rid", F.map_from_arrays("hashes", "words").alias("w"))
    # Both sides are as many as texts with a candidate; a first with very many is split by the planner.
    both = pairs.join(lines.hint("merge"), "rid").join(lines.select(F.col("rid").alias("first"), F.col("w").alias("v")).hint("merge"), "first")
    zero = F.lit(0).cast("long")
    common = F.aggregate(F.map_entries("w"), zero, lambda a, e: a + F.least(e["value"], F.coalesce(F.element_at("v", e["key"]), F.lit(0))))
    total = lambda c: F.aggregate(F.map_values(c), zero, lambda a, x: a + x)
    linked = both.withColumn("c", common).filter(F.col("c") >= F.lit(ALIKE) * (total("w") + total("v") - F.col("c")))
    return components(linked.select(F.col("rid").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("rid"), "root")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each document: doc_id, host (as a key without nulls), tie (a hash of the text), the rules' counts, its lines' hashes and words, and keys of bands of these."""
    inner = docs.select(F.col("doc_id"), null_key(host).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.col("text"))
    at = T.StructType([*inner.schema.fields[:3], *RULES.fields, T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for part in slices(batches):
            texts = [x or "" for x in part.column(3).to_pylist()]
            counts = np.array([rules(x) for x in texts], dtype=np.int64).reshape(-1, len(RULES))
            lines = [lines_of(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(counts[:, i]) for i in range(len(RULES))), pa.array([list(x) for x in lines], pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int32())), pa.array([bands_of(list(x)) for x in lines], pa.list_(pa.int64()))],
                names=at.names,
            )

    return inner.mapInArrow(tidy(run), at)


def above_limit(n: Column, of: Column, share: float = SHARE, chance: float = CHANCE) -> Column:
    """Whether n documents of so many are too many for a line."""
    p = n / of
    rest = F.when(n < of, (of - n) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return (p > share) & (n * F.log(p / share) + rest >= -math.log(chance))


def frequent_lines(measured: DataFrame, share: float = SHARE, chance: float = CHANCE) -> DataFrame:
    """(host, hash) of the lines that more of a host's documents hold than its limit, copies and near copies counted once."""
    texts = measured.groupBy("host", "tie").agg(F.min_by(F.struct("rid", "hashes", "words", "bands"), "rid").alias("t")).select("host", "t.*")
    texts = materialize(texts, "texts")
    # A document's own row counts it; its lines' rows count the lines.
    held = texts.join(near_copies(texts), "rid", "left").select("host", "root", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("hash"))
    counted = held.filter("root IS NULL").drop("root").unionByName(held.filter("root IS NOT NULL").distinct().drop("root"))
    counts = counted.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.filter("hash is null").select("host", F.col("n").alias("of"))
    # No line of one document can be above a limit.
    return spread_join(counts.filter("hash is not null and n > 1"), limits, "host", few=True).filter(above_limit(F.col("n"), F.col("of"), share, chance)).select("host", "hash")


def verdicts(docs: DataFrame, host: str = "source", share: float = SHARE, chance: float = CHANCE, most_lost: float = MOST_LOST) -> DataFrame:
    """A row for each document: doc_id, host, tie, its counts, words lost to removed lines, those lines' hashes, base_failed and kept."""
    measured = materialize(measure(docs, host).withColumn("rid", F.monotonically_increasing_id()), "quality")
    frequent = frequent_lines(measured, share, chance)
    lines = measured.select("rid", "host", F.explode(F.arrays_zip("hashes", "words")).alias("line")).select("rid", "host", F.col("line.hashes").alias("hash"), F.col("line.words").alias("w"))
    # A line that a large host's documents share is as hot as the host.
    lost = spread_join(lines, frequent, ["host", "hash"]).groupBy("rid").agg(F.sum("w").alias("lost"), F.collect_list("hash").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.drop("hashes", "words", "bands").join(lost, "rid", "left")
        .withColumn("n_lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_lost_words") <= F.lit(most_lost) * F.col("n_words")))
        .drop("lost")
    )


def without_lines(text: str, removed: set[int]) -> str:
    """The text without the lines whose hash is among the removed."""
    return "\n".join(line for line in text.split("\n") if not any(h in removed for h in lines_of(line)))


def clean(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """The documents kept, without the removed lines; n_chars, where it exists, follows the text."""
    at, schema = docs.columns.index("text"), docs.schema
    # Documents of one host and text have one verdict.
    found = verdicts(docs, host, **settings).filter(~F.col("kept") | F.col("removed").isNotNull()).select("host", "tie", "kept", "removed").dropDuplicates(["host", "tie"])
    names = [f"k{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("host", null_key(names[docs.columns.index(host)])).withColumn("tie", F.xxhash64(F.coalesce(names[at], F.lit(""))))
    rows = spread_join(rows, found, ["host", "tie"], "left").filter(F.coalesce("kept", F.lit(True))).select(*names, "removed")

    def run(batches):
        for b in slices(batches):
            texts = [without_lines(x, set(r)) if r and x else x for x, r in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            part = b.select(list(range(b.num_columns - 1)))
            yield part.set_column(at, part.schema.field(at), pa.array(texts, pa.string()))

    out = rows.mapInArrow(tidy(run), T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)])).toDF(*schema.names)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def digests(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", *RULES.names, "base_failed", "kept", "n_lost_words")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {SPAN - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM w WHERE len(w) >= {SPAN})),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rep AS (SELECT rid, count(DISTINCT i + k.range) AS n FROM again, range({SPAN}) k GROUP BY rid),
lines AS (SELECT rid, source, line, regexp_extract_all(line, '{WORD}') AS lw FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE len(lw) > 0 GROUP BY rid),
norm AS (SELECT rid, source, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s, len(lw) AS n FROM lines WHERE len(lw) > 0),
texts AS (SELECT source, min(rid) AS rid FROM d GROUP BY source, t),
bags AS (SELECT rid, norm.source, s, sum(norm.n) AS n FROM norm JOIN texts USING (rid) GROUP BY rid, norm.source, s),
sizes AS (SELECT rid, sum(n) AS n, count(*) AS lines FROM bags GROUP BY rid),
alike AS (SELECT a.rid AS a, b.rid AS b FROM bags a JOIN bags b ON a.s = b.s AND a.source IS NOT DISTINCT FROM b.source AND a.rid <> b.rid JOIN sizes x ON x.rid = a.rid AND x.lines > 1 JOIN sizes y ON y.rid = b.rid AND y.lines > 1
  GROUP BY a.rid, b.rid HAVING sum(least(a.n, b.n)) >= {ALIKE}::DOUBLE * (any_value(x.n) + any_value(y.n) - sum(least(a.n, b.n)))),
reach AS (SELECT a, b FROM alike UNION SELECT r.a, e.b FROM reach r JOIN alike e ON r.b = e.a),
classes AS (SELECT a AS rid, least(a, min(b)) AS root FROM reach GROUP BY a),
one AS (SELECT texts.source, texts.rid, coalesce(root, texts.rid) AS root FROM texts LEFT JOIN classes USING (rid)),
hosts AS (SELECT source, count(DISTINCT root)::DOUBLE AS m FROM one GROUP BY source),
held AS (SELECT norm.source, s, count(DISTINCT root)::DOUBLE AS n FROM norm JOIN one USING (rid) GROUP BY norm.source, s),
freq AS (SELECT held.source, s FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > 1 AND n / m > {SHARE}::DOUBLE
  AND n * ln(n / m / {SHARE}::DOUBLE) + CASE WHEN n < m THEN (m - n) * ln((1 - n / m) / (1 - {SHARE}::DOUBLE)) ELSE 0 END >= ln(1 / {CHANCE}::DOUBLE)),
lost AS (SELECT rid, sum(n) AS n FROM norm JOIN freq ON norm.s = freq.s AND norm.source IS NOT DISTINCT FROM freq.source GROUP BY rid),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words) AND n_lost_words <= {MOST_LOST}::DOUBLE * n_words AS kept FROM m
"""
