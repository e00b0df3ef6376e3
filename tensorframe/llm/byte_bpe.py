"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk_chars`` code points are encoded whole.  Longer ones are cut
into chunks that overlap; chunks are pre-tokenised in parallel, neighbours are
stitched at the first pre-token boundary of the overlap on which both agree
(from there on a left-to-right scan without memory goes on alike), and the
stitched segments are encoded piece by piece.  Where an overlap has no common
boundary (one pre-token covers it) the chunks are joined and scanned as one.
Decoding looks each id's bytes up and concatenates them; `encode` can do so in
the worker that made the ids, which saves a second worker for each task.

A worker holds one table of ranks (the library's), the bytes of all ids in one
array, and ids of pre-tokens seen, up to CACHE_BYTES.

Defined cases: a null text is the empty text and gives no ids; repeated rows and
repeated doc_ids are kept as separate rows; an empty table gives an empty
result; other columns pass through unchanged unless they are named like the
output.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe.llm.common import materialize, slices, tidy

#: White space as the tokenizer's own engine has it (Unicode White_Space).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Of pre-tokens and their ids, as Python objects.
CACHE_BYTES = 24_000_000
LONG_PIECE = 512


def portable(pattern: str) -> str:
    """The pattern with white space spelled out, which engines define differently."""
    return pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until no pair has a rank.

    A heap over a linked list: n log n also for pieces of a million bytes.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # a part is piece[i:end[i]]; its right neighbour starts at end[i]
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:  # the part is gone or has grown since
            continue
        end[i] = stop
        end[j] = 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Ids (as bytes of 32-bit numbers) by pre-token; filled on demand and emptied when full."""

    #: Of a string, a bytes object and their place in the table, besides what they hold.
    ENTRY = 220

    def __init__(self, rank_data: bytes, pattern: str) -> None:
        super().__init__()
        self.rank_data, self.ranks, self.held = rank_data, None, 0
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(rank_data), special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > LONG_PIECE:
            return np.array(self.merge_long(raw), np.int32).tobytes()
        ids = np.array(self.merge(raw), np.int32).tobytes()
        size = self.ENTRY + len(raw) + len(ids)
        if self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += size
        self[piece] = ids
        return ids

    def merge_long(self, raw: bytes) -> list[int]:
        """The library's time grows with the square of a piece, so long ones, which are few, have a table of their own."""
        if self.ranks is None:
            self.ranks = parse_ranks(self.rank_data)
        rank = self.ranks.get(raw)
        return merge(raw, self.ranks) if rank is None else [rank]


class _Bytes:
    """The bytes of ids, from one array that holds all of them."""

    STEP = 8192

    def __init__(self, rank_data: bytes) -> None:
        of = {v: k for k, v in parse_ranks(rank_data).items()}
        each = [of.get(i, b"") for i in range(max(of, default=-1) + 1)]
        self.size = np.array([*map(len, each), 0], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(each), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), self.STEP):
            part = ids[at : at + self.STEP]
            size = self.size[part]
            first = np.cumsum(size) - size
            out.append(self.all[np.arange(int(size.sum())) + np.repeat(self.start[part] - first, size)].tobytes())
        return b"".join(out)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32), pa.int32()))


def _numbers(rows: list[list[int]]) -> pa.Array:
    return _lists([np.array(x, np.int32).tobytes() for x in rows])


def encode(
    docs: DataFrame, rank_data: bytes, pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None, chunk_chars: int = 32_768, overlap: int = 256
) -> DataFrame:
    """docs with an array of ids instead of the text, and with the bytes that the ids decode to as column `decoded`."""
    keep = [c for c in docs.columns if c not in (text, out, decoded)]
    # Names of our own, so that no column of the caller can clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    keys = [f"k{i}" for i in range(len(keep))]
    whole = _encode_pieces(inner.filter(F.length("t") <= chunk_chars), rank_data, pattern, decoded is not None, 250)
    parts = _encode_long(inner.filter(F.length("t") > chunk_chars), keys, rank_data, pattern, chunk_chars, overlap, decoded is not None)
    both = whole.unionByName(parts)
    more = [F.col("raw").alias(decoded)] if decoded else []
    return both.select(*[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)], F.col("ids").alias(out), *more)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
RAW = T.StructField("raw", T.BinaryType())


def _encode_pieces(docs: DataFrame, rank_data: bytes, pattern: str, decoded: bool, rows: int) -> DataFrame:
    """docs with ids, and their bytes where decoded, instead of the text, which is the last column."""
    schema = T.StructType([*docs.schema.fields[:-1], IDS, *([RAW] if decoded else [])])

    def run(batches):
        cut, ids = regex.compile(portable(pattern)).findall, _Pieces(rank_data, pattern)
        bytes_of = _Bytes(rank_data) if decoded else None
        for part in slices(batches, rows):
            done = [b"".join(map(ids.__getitem__, cut(x))) for x in part.column(part.num_columns - 1).to_pylist()]
            more = [pa.array([bytes_of(np.frombuffer(x, np.int32)) for x in done], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(done), *more], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of a text."""
    return [m.start() for m in regex.finditer(portable(pattern), text)]


def _encode_long(docs: DataFrame, keys: list[str], rank_data: bytes, pattern: str, size: int, overlap: int, decoded: bool) -> DataFrame:
    # As a table, so that a task that is run again can't give its texts other numbers.
    chunks = (
        materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "long_texts")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.length("t") / size).cast("int") - 1)))
        # One code point beyond the overlap, so that a piece that ends with it is seen to end.
        .withColumn("t", F.substring("t", F.col("k") * size + 1, F.lit(size + overlap + 1)))
    )
    at = T.ArrayType(T.IntegerType())
    scan_schema = T.StructType([*chunks.schema.fields, *(T.StructField(c, at) for c in ("head", "tail", "sure"))])

    def scan(batches):
        starts = regex.compile(portable(pattern)).finditer
        space = regex.compile(f"[{SPACE}]").match
        for b in slices(batches, 64):
            heads, tails, sure = [], [], []
            for x in b.column(b.schema.get_field_index("t")).to_pylist():
                # Not after white space: how that is cut depends on what follows it.
                found = [p for m in starts(x) if (p := m.start()) and (p <= overlap or p > size) and not space(x, p - 1)]
                heads.append([p for p in found if p <= overlap])
                tails.append([p - size for p in found if size < p <= size + overlap])
                sure.append([p for p in heads[-1] if space(x, p)])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(_numbers, (heads, tails, sure))], names=[*b.schema.names, "head", "tail", "sure"])

    order = Window.partitionBy("rid").orderBy("k")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    stitched = (
        chunks.repartition(F.col("rid"), F.col("k")).mapInArrow(tidy(scan), scan_schema)
        .withColumn("agreed", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
        # A boundary before white space and after none is one whatever came before.
        .withColumn("sure", F.when(F.col("k") == 0, 0).otherwise(F.array_min("sure")))
        .withColumn("lost", F.coalesce(F.max(F.when(F.col("agreed").isNull(), F.col("k"))).over(earlier), F.lit(-1)))
        .withColumn("found", F.coalesce(F.max(F.when(F.col("sure").isNotNull(), F.col("k"))).over(earlier), F.lit(-1)))
        .withColumn("s", F.when(F.col("found") >= F.col("lost"), F.col("agreed")).otherwise(F.col("sure")))
        .withColumn("next", F.lead("s").over(order))
        .withColumn("seg", F.sum(F.col("s").isNotNull().cast("int")).over(so_far))
        .withColumn("core", F.expr(f"substring(t, coalesce(s, 0) + 1, {size} + coalesce(next, 0) - coalesce(s, 0))"))
    )
    segments = stitched.groupBy("rid", "seg").agg(
        *[F.first(k).alias(k) for k in keys],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "core"))), lambda x: x["core"]), "").alias("t"),
    )
    done = _encode_pieces(segments.repartition(F.col("rid"), F.col("seg")), rank_data, pattern, decoded, 64)
    ordered = F.sort_array(F.collect_list(F.struct("seg", *(["ids", "raw"] if decoded else ["ids"]))))
    # By way of hex, as there is no join of an array of bytes.
    raw = [F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["raw"])), "")).alias("raw")] if decoded else []
    whole = done.groupBy("rid").agg(*[F.first(k).alias(k) for k in keys], ordered.alias("parts"))
    return whole.select(*keys, F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), *raw)


def decode(tokens: DataFrame, rank_data: bytes, ids: str = "token_ids", out: str = "bytes") -> DataFrame:
    """tokens with the ids' raw bytes, one after another; null ids give null bytes."""
    schema = T.StructType([*(f for f in tokens.schema.fields if f.name != out), T.StructField(out, T.BinaryType())])
    names = schema.names

    def run(batches):
        bytes_of = _Bytes(rank_data)
        for part in slices(batches):
            rows = part.column(part.schema.get_field_index(ids))
            done = [None if x is None else bytes_of(x.values.to_numpy()) for x in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names[:-1]), pa.array(done, pa.binary())], names=names)

    return tokens.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, rank_data: bytes, pattern: str) -> DataFrame:
    """Per row: doc_id, number of ids, and digests of the ids and of the bytes they decode to."""
    ids = encode(docs.select("doc_id", "text"), rank_data, pattern, decoded="raw")
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
