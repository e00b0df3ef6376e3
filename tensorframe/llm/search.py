"""Ranked lexical search by windowed bucket scoring.

A document is a bag of terms: runs of letters, digits and characters beyond
ASCII, with A to Z lower-cased.  It is ranked for a query by the sum, over the
query's terms, of a saturating weight of the term's count in it (BM25 in integer
arithmetic, so that every engine gives the same score).

Documents become vectors of the terms that queries ask for, which are written
once; numbers of documents and terms and each term's document frequency are
summed up from all of them.  The vectors are dealt out by windows of WINDOW
document ids, and within a window turned into postings.  A query is scored in a
window at a time: each posting list is added into an array that has a cell for
each document of the window and fits a core's cache, while a bitset of the
window, the union of the lists' bitsets, says which cells are occupied; these
are harvested into the heap of the query's best, and cleared.  The heaps of all
tasks, k rows a query each, are merged by rank.

Queries are taken in blocks of about BLOCK_TERMS terms, so what travels to the
tasks is bounded whatever the number of queries; each block runs against all
documents.

Defined cases: a null or empty text has no terms, and a document without terms
counts for nothing; a query without terms, or whose terms no document holds, has
no rows; rows with one query id, null too, are one query; rows with one doc_id
are documents of their own, of which repeated ones have equal scores; rows
without a doc_id come after others of their score; equal scores go by ascending
doc_id; an empty table gives an empty result; other columns, whatever their
names, are ignored.  A text is read in pieces, so its words are never a list as
long as the text.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorframe.llm.common import materialize, slices, table, tidy

#: Document ids in a window: an array of 64-bit scores for them takes 64 KB.
WINDOW = 8192
#: Distinct terms of a block of queries, on average; a query is never split.
BLOCK_TERMS = 200_000
K = 50
#: Postings of a window that are in memory at a time; a window with more is scored in parts.
POSTINGS = 4_000_000
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 22

_letters = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_folded = bytes(_letters[c] + 32 if 0x41 <= c <= 0x5A else _letters[c] for c in range(256))


def bag(text: bytes) -> Counter:
    """Count of each term of a UTF-8 text; a byte beyond ASCII is always inside a term."""
    text, counts, at = text.translate(_folded), Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        counts.update(text[at:end].split())
        at = end
    return counts


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query, term): the distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, terms = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = bag(x or b"")
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["query", "term"])

    return queries.select(F.col(query_id).cast("long"), F.col(text).cast("binary")).mapInArrow(tidy(run), "query long, term binary").distinct()


def vectors(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts, at) of each document with a term: its length, places in the vocabulary with counts, and its place in the task."""
    place = {t: k for k, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in slices(batches):
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = bag(x or b"")
                if not own:
                    continue
                ids.append(i)
                lengths.append(own.total())
                for t in own.keys() & place.keys():
                    terms.append(place[t])
                    counts.append(own[t])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists, pa.array(range(seen, seen + len(ids)), pa.int64())], names=["doc_id", "n", "terms", "counts", "at"])
            seen += len(ids)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, counts array<long>, at long")


def frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of `size` terms, by one vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["term", "df"])

    found = bags.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """The postings of a window: for each term the documents' cells, what each adds to a score, and a bitset of them."""

    def __init__(self, ids: list, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int, weights: np.ndarray) -> None:
        self.ids = ids
        m = 50 + (50 * lengths * n_docs) // n_terms
        cells = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        cells, terms, counts = cells[order], terms[order], counts[order]
        adds = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[cells]))
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        self.lists = {}
        for t, lo, hi in zip(terms[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True):
            bits = np.zeros(len(ids), bool)
            bits[cells[lo:hi]] = True
            self.lists[t] = cells[lo:hi], adds[lo:hi], np.packbits(bits)

    def harvest(self, query: list[int], scores: np.ndarray, heap: list, k: int) -> None:
        """Add up a query's posting lists in the array of scores (all 0, and so again after), and its best into the heap."""
        lists = [self.lists[t] for t in query if t in self.lists]
        if not lists:
            return
        occupied = np.zeros(len(lists[0][2]), np.uint8)
        for cells, adds, bits in lists:
            scores[cells] += adds
            occupied |= bits
        cells = np.flatnonzero(np.unpackbits(occupied, count=len(self.ids)))
        found = scores[cells]
        scores[cells] = 0
        good = found >= (heap[0][0] if len(heap) == k else 1)
        cells, found = cells[good], found[good]
        if len(found) > k:  # ties of the k-th best stay: ids decide
            good = found >= np.partition(found, -k)[-k]
            cells, found = cells[good], found[good]
        for cell, score in zip(cells.tolist(), found.tolist(), strict=True):
            i = self.ids[cell]
            entry = (score, i is not None, -(i or 0))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k first of each query, ranked; the planner keeps k a query of each task before it shuffles."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, pairs: list, k: int, window: int, doc_id: str, text: str) -> DataFrame:
    vocabulary = sorted({t for _, t in pairs})
    place = {t: i for i, t in enumerate(vocabulary)}
    queries: dict[int | None, list[int]] = {}
    for q, t in pairs:
        queries.setdefault(q, []).append(place[t])
    bags = materialize(vectors(docs, vocabulary, doc_id, text), "bags")
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = frequencies(bags, len(vocabulary))
    weights = np.array([weight(n_docs, x) if x else 0 for x in df.tolist()], np.int64)
    # Ranges of ids.  A window need not be in one task, as a document's score is its own, so rows of one id, or of none, are cut too.
    dealt = bags.filter(F.size("terms") > 0).withColumn("window", F.expr(f"doc_id div {window}L")).repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {q: [] for q in queries}
        scores = np.zeros(window, np.int64)
        parts: list[pa.RecordBatch] = []

        def end() -> None:
            if not parts:
                return
            whole = pa.Table.from_batches(parts).combine_chunks()
            terms = whole.column("terms").combine_chunks()
            sizes = terms.value_lengths().to_numpy()
            postings = Postings(whole.column("doc_id").to_pylist(), whole.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), whole.column("counts").combine_chunks().flatten().to_numpy(), n_docs, n_terms, weights)
            for q, heap in heaps.items():
                postings.harvest(queries[q], scores, heap, k)
            parts.clear()

        last, held, heavy = None, 0, 0
        for b in slices(batches, window, 16_000_000):
            windows = b.column(5).fill_null(-(1 << 62)).to_numpy()
            for part in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(windows)) + 1):
                at, rest = int(part[0]), len(part)
                while rest:
                    if held == window or windows[at] != last or heavy > POSTINGS:
                        end()
                        last, held, heavy = windows[at], 0, 0
                    taken = min(rest, window - held)
                    parts.append(b.slice(at, taken))
                    at, rest, held, heavy = at + taken, rest - taken, held + taken, heavy + b.nbytes // 12
        end()
        rows = [(q, -i if known else None, score) for q, heap in heaps.items() for score, known, i in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query", "doc_id", "score"])

    return dealt.mapInArrow(tidy(run), "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, window: int = WINDOW, query_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of each query, of those with a score above 0."""
    pairs = materialize(query_terms(queries, query_id, text), "queries")
    blocks = max(1, -(-pairs.count() // block_terms))
    out = None
    for b in range(blocks):
        # Bounded by the block, whatever the number of queries.
        block = pairs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        found = _search_block(docs, [(x.query, bytes(x.term)) for x in block], k, window, doc_id, text)
        out = found if out is None else out.unionByName(found)
    return _best(out, k).select("query", "rank", "doc_id", "score")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("query", "item_id")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{_TERM}')) AS term FROM d),
len AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM len),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}')) AS term FROM benchmark),
tf AS (SELECT rid, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
c AS (SELECT tf.rid, tf.term, wt.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))) AS c FROM tf JOIN len USING (rid) JOIN wt USING (term), s),
r AS (SELECT item_id, rid, sum(c)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY item_id, rid HAVING sum(c) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r JOIN d USING (rid) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {K}"""
