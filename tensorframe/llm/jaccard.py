"""N-gram Jaccard join with Bayesian candidate pruning.

Words are shingled by five; documents whose distinct shingles have a Jaccard
similarity of at least 0.8 are linked.

1. Each text gets its shingles' MinHash values.  Equal texts are one
   representative from here on; their number is kept as a weight.
2. Candidates share a band of four values (32 bands: a pair at the threshold is
   missed with a probability of (1 - 0.8^4)^32 < 5e-8).  Buckets with the same
   members are kept once.
3. In a bucket, values are compared sixteen at a time; a pair is dropped once the
   posterior probability (uniform prior) that its similarity reaches the
   threshold is below a tolerance of 1e-6.  A bucket gives only edges that span
   the surviving pairs, however many these are.
4. Connected components of the survivors are verified exactly: shingle sets are
   intersected in blocks of a component, and only counts of links and spanning
   edges leave a block.  Blocks of large components are dealt out in pairs.  Up to
   SPREAD blocks are small, so that machines share a group; beyond that blocks grow
   to a bound of rows and shingles, so that a text isn't sent to too many pairs.
5. Components of the verified links are the classes.

Defined cases: a text without words (or null) has no links and is its own class;
fewer than five words are one shingle; equal texts and repeated rows are linked
to one another; a class's id is its smallest doc_id (null if it has none); an
empty table gives an empty result; other columns are ignored.  Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe.llm.common import materialize, slices, spread_join, tidy
from tensorframe.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
VALUES, ROWS = 128, 4
STEP = 16
TOLERANCE = 1e-6
#: Rows of a bucket's and of a component's block, and number of such blocks; then the most rows, and shingles, that a
#: block of a larger group may have.
BUCKET_BLOCK, TEXT_BLOCK, SPREAD = 512, 128, 32
BUCKET_ROWS = 65_536
TEXT_ROWS, TEXT_SHINGLES = 8192, 2_000_000
#: Sets compared at a time on either side.
TILE = 512
#: Shingles sorted at a time when sets are intersected.
RANGE = 500_000

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of five words; one run if there are fewer."""
    found = (text or "").encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, found)), dtype=np.uint64)
    span = min(words, len(h))
    x = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        x = x * _K + h[i : len(h) - span + 1 + i]
    return np.unique(_mixed(x))


_SEEDS = _mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * _K)
_A, _B = (_SEEDS[:VALUES] | np.uint64(1))[:, None], _SEEDS[VALUES:][:, None]


def minhash(x: np.ndarray) -> np.ndarray:
    """The least of 128 affine hashes of the shingles, their upper 32 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[None, i : i + 4096] * _A + _B).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared: the fewest matches with which a pair goes on.

    With m of n equal and a uniform prior the similarity is Beta(m + 1, n - m + 1);
    the chance that it reaches t is that of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def survivors(values: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs (i, j) that are not dropped."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    for n, m in least.items():
        matches += (values[i[left], n - STEP : n] == values[j[left], n - STEP : n]).sum(axis=1, dtype=np.int32)
        on = matches >= m
        left, matches = left[on], matches[on]
        if not len(left):
            break
    return left


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(values: np.ndarray, side: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Labels of the components of the surviving pairs of a large block, without visiting each pair.

    Members reached are not compared again; only opposite sides are compared where there are two.
    """
    two = bool(side.any())
    label = np.arange(len(values))
    free = np.ones(len(values), bool)
    for first in range(len(values)):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue:
            p = queue.pop()
            others = np.flatnonzero(free & (side != side[p]) if two else free)
            for at in range(0, len(others), 8192):
                part = others[at : at + 8192]
                new = part[survivors(values, np.full(len(part), p), part, least)]
                free[new] = False
                label[new] = first
                queue += new.tolist()
    return label


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that agree in the first columns; rows must come group by group."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(b.num_rows, bool)
        for i, k in enumerate(keys):
            new[1:] |= k[1:] != k[:-1]
            new[0] |= not kept or kept[-1].column(i)[-1].as_py() != k[0]
        starts = np.flatnonzero(new)
        if not len(starts):
            kept.append(b)
            continue
        if starts[0]:
            kept.append(b.slice(0, int(starts[0])))
        if starts[-1] > starts[0] or kept:
            whole = [*kept, b.slice(int(starts[0]), int(starts[-1] - starts[0]))]
            yield pa.Table.from_batches([x for x in whole if x.num_rows])
        kept = [b.slice(int(starts[-1]))]
    if kept:
        yield pa.Table.from_batches(kept)


def _starts(t: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for i in range(n_keys):
        k = t.column(i).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def blocks_of(size: Column, rows: int, most_rows: int, shingles: Column | None = None) -> Column:
    """The number of blocks that a group of some rows (and shingles) is cut into."""
    need = [F.least(F.ceil(size / rows), F.lit(SPREAD)), F.ceil(size / most_rows)]
    return F.greatest(*need, *([F.ceil(shingles / TEXT_SHINGLES)] if shingles is not None else [])).cast("int")


def in_blocks(rows: DataFrame, group: str, many: Column) -> DataFrame:
    """rows with (i, j, side): each pair of a large group's blocks becomes a group of its own."""
    own = F.pmod(F.xxhash64("rid", F.col(group)), many).cast("int")
    places = F.transform(
        F.sequence(F.lit(0), many - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).cast("int").alias("side")),
    )
    return rows.withColumn("_place", F.explode(places)).withColumns({c: F.col(f"_place.{c}") for c in ("i", "j", "side")}).drop("_place")


def signatures(docs: DataFrame) -> DataFrame:
    """rid, doc_id, digest of the text, number of shingles, MinHash values."""
    inner = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    schema = T.StructType([*inner.schema.fields[:2], T.StructField("n", T.IntegerType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingles(x, hashes) for x in part.column(2).to_pylist()]
            values = np.concatenate([minhash(x) for x in sets])
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * VALUES, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int32()), sig], names=schema.names)

    return inner.mapInArrow(tidy(run), schema).withColumn("rid", F.monotonically_increasing_id())


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def candidate_edges(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): edges that span the pairs which share a band and survive the comparison of values."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(VALUES // ROWS - 1)), lambda k: F.xxhash64(k, *(F.get("sig", k * ROWS + r) for r in range(ROWS))))
    bands = reps.select("rid", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).filter("size > 1")
    once = buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    members = bands.join(once, "key").join(reps.select("rid", "sig"), "rid")
    rows = in_blocks(members, "key", blocks_of(F.col("size"), BUCKET_BLOCK, BUCKET_ROWS)).select("key", "i", "j", "side", "rid", "sig")
    least = least_matches(threshold, tolerance)

    def run(batches):
        for t in groups(batches, 3):
            starts = _starts(t, 3)
            side, rid = t.column("side").to_numpy(), t.column("rid").to_numpy()
            values = pa.concat_arrays(t.column("sig").chunks).flatten().to_numpy().reshape(-1, VALUES)
            a, b, pending, left, right = [], [], 0, [], []

            def settle():
                if not left:
                    return
                i, j = np.concatenate(left), np.concatenate(right)
                on = survivors(values, i, j, least)
                nodes, at = np.unique(np.concatenate([i[on], j[on]]), return_inverse=True)
                label = labels_of(len(nodes), at[: len(on)], at[len(on) :])
                apart = label != np.arange(len(nodes))
                a.append(rid[nodes[label[apart]]])
                b.append(rid[nodes[apart]])
                left.clear()
                right.clear()

            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s > 64 or side[s:e].any():
                    label = spanning(values[s:e], side[s:e], least)
                    apart = np.flatnonzero(label != np.arange(e - s))
                    a.append(rid[s + label[apart]])
                    b.append(rid[s + apart])
                elif e - s > 1:
                    i, j = np.triu_indices(e - s, 1)
                    left.append(i + s)
                    right.append(j + s)
                    pending += len(i)
                    if pending > 50_000:
                        settle()
                        pending = 0
            settle()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=EDGES.names)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(run), EDGES)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of left sets with right ones (or one another), by products of 0/1 matrices of bounded width."""
    sets = left + (right or [])
    m = len(left)
    out = np.zeros((m, len(right) if right is not None else m), np.float64)
    if len(sets) <= 4:
        for i in range(m):
            for j in range(i + 1, m) if right is None else range(len(right)):
                out[i, j] = len(np.intersect1d(left[i], left[j] if right is None else right[j], assume_unique=True))
                if right is None:
                    out[j, i] = out[i, j]
        return out
    # By ranges of hashes, so that what is sorted at a time is bounded, however long the texts.
    n = -(-sum(map(len, sets)) // RANGE) or 1
    cuts = [np.searchsorted(x, np.array([(k << 64) // n for k in range(1, n)], np.uint64)) for x in sets]
    for k in range(n):
        parts = [x[(c[k - 1] if k else 0) : (c[k] if k < n - 1 else len(x))] for x, c in zip(sets, cuts, strict=True)]
        _add_shared(out, parts, m if right is not None else None)
    return out


def _add_shared(out: np.ndarray, sets: list[np.ndarray], split: int | None) -> None:
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for at in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[owner[s:e], column[s:e] - at] = 1
        out += x @ x.T if split is None else x[:split] @ x[split:].T


def links_of(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, two: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Each set's links, copies counted, and the least set of those it is linked with; only opposite sides where there are two."""
    size = np.array([len(x) for x in sets], np.float64)
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    every = np.arange(len(sets))
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (every, every)
    for p in range(0, len(a), TILE):
        for q in range(0 if two else p, len(b), TILE):
            i, j = a[p : p + TILE], b[q : q + TILE]
            same = not two and p == q
            shared = shared_counts([sets[k] for k in i], None if same else [sets[k] for k in j])
            linked = shared >= threshold * (size[i][:, None] + size[j][None, :] - shared) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            links[i] += linked @ copies[j]
            if not same:
                links[j] += linked.T @ copies[i]
            x, y = np.nonzero(linked)
            label = labels_of(len(sets), np.concatenate([i[x], every]), np.concatenate([j[y], label]))
    return links, label


LINKS = T.StructType([T.StructField("rid", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType()), T.StructField("whole", T.BooleanType())])


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """members (comp, i, j, side, rid, copies, whole, text) to links counted and roots within each block pair."""

    def run(batches):
        hashes = WordHashes()
        for t in groups(batches, 3):
            starts = _starts(t, 3)
            out = [[], [], [], []]
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                g = t.slice(s, e - s)
                side, rid, copies = (g.column(c).to_numpy() for c in ("side", "rid", "copies"))
                sets = [shingles(x.as_py(), hashes) for x in g.column("text")]
                links, label = links_of(sets, side, copies.astype(np.int64), g.column("i")[0].as_py() != g.column("j")[0].as_py(), threshold)
                on = np.flatnonzero(links)
                for o, x in zip(out, (rid[on], rid[label[on]], links[on], np.full(len(on), g.column("whole")[0].as_py())), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=LINKS.names)

    rows = members.select("comp", "i", "j", "side", "rid", "copies", "whole", "text")
    return rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(tidy(run), LINKS)


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links (to other documents)."""
    signed = materialize(signatures(docs), "signatures")
    reps = signed.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    reps = materialize(reps, "representatives")
    values = signed.select("rid", "sig").join(reps.select("rid"), "rid", "left_semi")
    comps = components(materialize(candidate_edges(values, threshold, tolerance), "candidates"))

    of_comp = comps.join(reps, F.col("node") == F.col("rid")).select(F.col("root").alias("comp"), "rid", "first", "copies", "n", "digest")
    many = of_comp.groupBy("comp").agg(blocks_of(F.count(F.lit(1)), TEXT_BLOCK, TEXT_ROWS, F.sum("n")).alias("many"))
    members = materialize(spread_join(of_comp, many, "comp"), "members")
    # Texts come from the documents again, one for each member: shingles of all documents would fill the disks.
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-1))
    texts = docs.select(key(F.col("doc_id")).alias("_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_digest"), "text")
    # A merge join at every size: members grow with the documents, so a plan that broadcasts them would not last.
    wanted = members.withColumn("_id", key(F.col("first"))).withColumnRenamed("digest", "_digest")
    found = texts.join(wanted.hint("merge"), ["_id", "_digest"]).dropDuplicates(["rid"])
    blocks = in_blocks(found.withColumn("whole", F.col("many") == 1), "comp", F.col("many"))
    links = materialize(verified(blocks, threshold), "links")

    spread = components(links.filter(~F.col("whole")).select(F.col("rid").alias("a"), F.col("root").alias("b")))
    roots = links.filter("whole").select("rid", "root").unionByName(spread.select(F.col("node").alias("rid"), "root"))
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"))
    linked = roots.join(counts, "rid").join(reps.select("rid", "first"), "rid")
    classes = linked.groupBy("root").agg(F.min("first").alias("class_first"))
    linked = spread_join(linked, classes, "root").select("rid", "links", "class_first")
    of_text = reps.join(linked, "rid", "left").select(
        "digest", F.when(F.col("links").isNull(), F.col("first")).otherwise(F.col("class_first")).alias("_class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
    )
    # A text without words has no representative; one with very many copies is dealt out.
    return spread_join(signed.select("doc_id", "digest", "n"), of_text, "digest", "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("_class")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that another of their class, the one with the smallest doc_id, stands for.

    A doc_id names a document: its repeated rows of one text become one, and rows
    without one are kept, as nothing tells them apart.
    """
    kept = join(docs, threshold).filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    rows = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()))


WORD_SQL = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, text, count(*) AS copies, min(doc_id) AS first FROM documents WHERE regexp_matches(text, '{WORD_SQL}') GROUP BY text),
w AS (SELECT k, regexp_extract_all(text, '{WORD_SQL}') AS w FROM t),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM w)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE shared >= {THRESHOLD} * (a.n + b.n - shared) - 1e-9),
r AS (SELECT k AS x, k AS y FROM t UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT r.x, min(t.first) AS class_id FROM r JOIN t ON t.k = r.y GROUP BY r.x),
m AS (SELECT x, sum(t.copies) AS links FROM l JOIN t ON t.k = l.y GROUP BY x)
SELECT d.doc_id, CASE WHEN t.k IS NULL THEN d.doc_id ELSE c.class_id END AS class_id, coalesce(t.copies - 1 + coalesce(m.links, 0), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.x = t.k LEFT JOIN m ON m.x = t.k
"""
