"""Secret scans.

Named shapes (assignments to secret-like names, access keys, long hex runs) are
found by patterns.  Other candidate strings are judged by the Shannon entropy of
a sliding window, per character class of the window, whose counts are updated by
one character in and one out; candidates are cut at name/value separators.  Names
in code, slugs and paths have as much entropy as keys, but their letters follow
one another as in words: the same window counts its pairs of letters, and those
that are common in words; with more than WORDLIKE of the one among the other it
reads as words, and is let pass.  So is a window that touches a base span, or a
known harmless string of the allow-list; the others of its candidate are judged,
and those that reach their class's bar make a span where they overlap.

Defined cases: a null text has no spans; repeated rows and doc_ids are scanned
as separate rows; an empty table gives an empty result; other columns pass
through, save one named like the output.  Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe.llm.common import slices, tidy

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What stands between the separators of names and values; signs of equality at the end fill up base64.
PIECE = r"[A-Za-z0-9+/_-]+(?:=+$)?"
WINDOW = 20
#: Bits a character that a window must reach, by the class of its characters.  Random windows have 3.4 bits on average
#: (hex), 4.0 (mixed), 3.9 (alnum), 2.9 (digits), 4.0 (cased) and 3.7 (letters).
BITS = {"hex": 3.0, "mixed": 3.7, "alnum": 3.4, "digits": 2.6, "cased": 3.7, "letters": 3.3}
#: Pairs of letters that are common in words of English, most of them in German, French and Spanish too.
#: A quarter of random pairs is among them, and three quarters or more of those of words.
PAIRS = (
    "ab ac ad ag ai al am an ap ar as at av ay be bl bo br ca ce ch ci ck cl co cr ct cu da de di do ea ec ed ee ef ei el em en er es et ev ex "
    "fa fi fo fr ga ge gi gr gu ha he hi ho ic id ie if ig il im in io ir is it iv ke ki la ld le li ll lo ls ly ma me mi mo mp mu na nd ne ng ni no ns nt "
    "od of og ol om on oo op or os ot ou ov ow pa pe ph pl po pr qu ra rd re ri rn ro rs rt ry sa sc se sh si so sp ss st su ta te th ti tl to tr ts tu ty "
    "ui ul un up ur us ut va ve vi wa we wh wi wo ye"
).split()
#: A window with at least so many pairs of letters reads as words if more than its class's share of them is common.
LEAST_PAIRS = 6
WORDLIKE = {"letters": 0.5, "cased": 0.5, "alnum": 0.55, "mixed": 0.55}
#: What is let pass within a candidate; the last four match a whole one.
ALLOW = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|lorem",
    r"(?i)0123456789|abcdefgh|qwerty",
    r"^(?:/[a-z0-9_-]+)+/?$",  # a path in lower case
    r"^[A-Za-z]{1,19}(?:[-_/=+][A-Za-z]{1,19})*$",  # words joined by signs
    r"^[0-9]{1,19}(?:[+/_=-]+[0-9]{1,19})*$",  # numbers joined by signs
    r"^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9][0-9]*$",  # a time stamp
)


#: Digits, letters that hex has and others, by case; 5 is all else.
GROUPS = {c: g for g, cs in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs}


def class_of(groups: list[int]) -> str | None:
    digits, af, lower, upper_af, upper, signs = groups
    one_case = not (af or lower) or not (upper_af or upper)
    if not (af or lower or upper_af or upper):
        return "digits" if digits and not signs else None
    if not digits:
        return None if signs else "letters" if one_case else "cased"
    if signs or not one_case:
        return "mixed"
    return "alnum" if lower or upper else "hex"


def char_class(text: str) -> str | None:
    """hex, alnum (digits and letters of one case), mixed (digits, letters and signs), digits, letters (of one case), cased, or None for what can't be judged."""
    groups = [0] * 6
    for c in text:
        groups[GROUPS.get(c, 5)] += 1
    return class_of(groups)


_common = frozenset(PAIRS)


def pair_of(text: str, i: int) -> int:
    """Of the characters before and at i: 0 if they are no two ASCII letters, 1 if they are, 2 if common in words."""
    if not i:
        return 0
    p = text[i - 1 : i + 1]
    return 0 if not (p.isascii() and p.isalpha()) else 1 + (p.lower() in _common)


def dense_parts(text: str, blocked: Sequence[tuple[int, int]] = (), window: int = WINDOW, bits: dict[str, float] = BITS) -> list[tuple[int, int]]:
    """Unions of overlapping windows whose entropy reaches the bits of their class, that don't read as words and touch no blocked span."""
    if len(text) < window:
        return []
    # Entropy in bits is log2(w) - sum(c * log2(c)) / w, so the sum must stay below this.
    most = {k: (math.log2(window) - b) * window + 1e-9 for k, b in bits.items()}
    most[None] = -1.0
    groups = [0] * 6
    xlog = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    counts: dict[str, int] = {}
    pairs = [pair_of(text, i) for i in range(len(text))]
    letters = common = 0
    total, out = 0.0, []
    blocks = iter(sorted(blocked))
    start, stop = next(blocks, (len(text), len(text)))
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlog[n + 1] - xlog[n]
        groups[GROUPS.get(c, 5)] += 1
        letters += pairs[i] > 0
        common += pairs[i] > 1
        if i >= window:  # the pair whose first character leaves
            gone = pairs[i - window + 1]
            letters -= gone > 0
            common -= gone > 1
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += xlog[n - 1] - xlog[n]
            groups[GROUPS.get(old, 5)] -= 1
        at = i - window + 1
        while stop <= at:
            start, stop = next(blocks, (len(text), len(text) + window))
        if at >= 0 and i < start and total <= most[kind := class_of(groups)] and (letters < LEAST_PAIRS or common <= WORDLIKE.get(kind, 1) * letters):
            if out and at < out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((at, i + 1))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Scanner:
    def __init__(self, allow: tuple[str, ...] = ALLOW, window: int = WINDOW, bits: dict[str, float] = BITS) -> None:
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a shorter one never hides a longer
        self.candidate, self.piece = re.compile(CANDIDATE), re.compile(PIECE)
        self.allow = [re.compile(p) for p in allow]
        self.window, self.bits = window, bits

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of kind, end), in order."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        base = sorted(found)
        for at, string in self.pieces(text):
            blocked = [m.span() for p in self.allow for m in p.finditer(string)]
            blocked += [(a - at, b - at) for a, _, b in base if a < at + len(string) and at < b]
            found += [(at + start, 3, at + end) for start, end in dense_parts(string, merged(blocked), self.window, self.bits)]
        return sorted(found)

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        for m in self.candidate.finditer(text):
            for p in self.piece.finditer(m.group()):
                if p.end() - p.start() >= self.window:
                    yield m.start() + p.start(), p.group()


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _named(docs: DataFrame) -> tuple[DataFrame, list[T.StructField]]:
    """docs under names of our own, as Arrow functions take no name with a dot, and their fields."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]


def scan(docs: DataFrame, text: str = "text", out: str = "spans", **settings) -> DataFrame:
    """docs with the spans of each text, by start and then kind."""
    at = docs.columns.index(text)
    inner, fields = _named(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = Scanner(**settings)
        for b in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner(x or "")] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, "spans"])

    done = inner.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("spans", SPANS)]))
    keep = [(f.name, c) for f, c in zip(fields, docs.columns, strict=True) if c != out]
    return done.select(*[F.col(k).alias(c) for k, c in keep], F.col("spans").alias(out))


def joined(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs.select("doc_id", "text")).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _any_case(pattern: str) -> str:
    """The pattern's ASCII letters outside brackets in either case, as engines differ on what else a flag would match."""
    return re.sub(r"\[[^]]*\]|\\x..|\\.|[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]" if len(m[0]) == 1 else m[0], pattern)


def oracle_sql() -> str:
    """digests() as SQL: matches are placed by the lengths of the pieces between them, windows are unnested."""
    quoted = lambda x: x.replace("'", "''")
    assign = quoted(_any_case(ASSIGN))

    def placed(name: str, source: str, keys: str, text: str, pattern: str) -> str:
        """Rows (keys, match, pos) of a pattern's matches."""
        return f"""{name} AS (SELECT {keys}, match, (sum(length(before) + length(match)) OVER (PARTITION BY {keys} ORDER BY n) - length(match))::BIGINT AS pos
  FROM (SELECT {keys}, unnest(m) AS match, unnest(p[1:len(m)]) AS before, unnest(range(len(m))) AS n FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS p FROM {source}))),
"""

    classes = [f"length(regexp_replace(s, '[^{c}]', '', 'g')) AS {n}" for n, c in (("dg", "0-9"), ("la", "a-f"), ("lo", "g-z"), ("ua", "A-F"), ("up", "G-Z"), ("sg", ""))]
    classes[-1] = "length(regexp_replace(s, '[0-9A-Za-z]', '', 'g')) AS sg"
    bars = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in BITS.items())
    allowed = ""
    for k, pattern in enumerate(ALLOW):
        pattern = quoted(pattern)
        allowed += placed(f"al{k}", "piece", "rid, pid", "s", pattern)
    blocked = " UNION ALL ".join(f"SELECT rid, pid, pos AS x, pos + length(match) AS y FROM al{k}" for k in range(len(ALLOW)))
    w = WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{placed("ass", "d", "rid", "t", assign)}{placed("acc", "d", "rid", "t", "AKIA[A-Z0-9]+")}{placed("hexs", "d", "rid", "t", "[0-9a-f]+")}base AS (
  SELECT rid, 0 AS k, pos AS x, pos + length(match) AS y FROM ass WHERE length(regexp_extract(match, '{assign}', 2)) >= 8
  UNION ALL SELECT rid, 1, pos, pos + length(match) FROM acc WHERE length(match) >= 16
  UNION ALL SELECT rid, 2, pos, pos + length(match) FROM hexs WHERE length(match) >= 32),
{placed("cand", "d", "rid", "t", CANDIDATE)}{placed("part", "(SELECT rid, pos AS cat, match AS s FROM cand)", "rid, cat", "s", PIECE)}piece AS (SELECT rid, cat + pos AS pid, match AS s FROM part WHERE length(match) >= {w}),
{allowed}blocked AS ({blocked} UNION ALL SELECT b.rid, p.pid, x - p.pid, y - p.pid FROM base b JOIN piece p ON p.rid = b.rid AND x < p.pid + length(p.s) AND p.pid < y),
win AS (SELECT rid, pid, i, s[i + 1:i + {w}] AS s FROM (SELECT rid, pid, s, unnest(range(length(s) - {w - 1})) AS i FROM piece)),
free AS (SELECT * FROM win WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.rid = win.rid AND b.pid = win.pid AND b.x < win.i + {w} AND win.i < b.y)),
sums AS (SELECT rid, pid, i, sum(c * log2(c)) AS total FROM (SELECT rid, pid, i, ch, count(*) AS c FROM (SELECT rid, pid, i, unnest(string_split(s, '')) AS ch FROM free) GROUP BY ALL) GROUP BY ALL),
cls AS (SELECT rid, pid, i, CASE WHEN la + lo + ua + up = 0 THEN CASE WHEN dg > 0 AND sg = 0 THEN 'digits' END
    WHEN dg = 0 THEN CASE WHEN sg = 0 THEN CASE WHEN la + lo = 0 OR ua + up = 0 THEN 'letters' ELSE 'cased' END END
    WHEN sg > 0 OR (la + lo > 0 AND ua + up > 0) THEN 'mixed' WHEN lo + up > 0 THEN 'alnum' ELSE 'hex' END AS class FROM (SELECT rid, pid, i, {", ".join(classes)} FROM free)),
prs AS (SELECT rid, pid, i, len(p) AS letters, len(list_filter(p, lambda x: list_contains([{", ".join(f"'{x}'" for x in PAIRS)}], lower(x)))) AS common
  FROM (SELECT rid, pid, i, list_filter(list_transform(range(1, {w}), lambda k: s[k:k + 1]), lambda x: regexp_full_match(x, '[A-Za-z]{{2}}')) AS p FROM free)),
hit AS (SELECT rid, pid + i AS pos FROM sums JOIN cls USING (rid, pid, i) JOIN prs USING (rid, pid, i) WHERE (letters < {LEAST_PAIRS} OR common <= CASE class {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WORDLIKE.items())} ELSE 1.0::DOUBLE END * letters) AND total <= (log2({w}) - CASE class {bars} END) * {w} + 1e-9),
isl AS (SELECT rid, pos, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS g FROM (SELECT rid, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) < {w} THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT * FROM base UNION ALL SELECT rid, 3, min(pos), max(pos) + {w} FROM isl GROUP BY rid, g),
o AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(n || ':' || x || ':' || y, ',' ORDER BY x, k) FILTER (k < 3), '') AS base, string_agg(n || ':' || x || ':' || y, ',' ORDER BY x, k) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] AS n FROM spans) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span replaced by the mask; n_chars, where it exists, follows the text."""
    at = docs.columns.index("text")
    inner, fields = _named(docs)

    def run(batches):
        scanner = Scanner()
        for b in slices(batches):
            done = []
            for x in b.column(at).to_pylist():
                pieces, end = [], 0
                for s, _, e in scanner(x or ""):
                    if s >= end:
                        pieces += [x[end:s], mask]
                    end = max(end, e)
                done.append("".join([*pieces, x[end:]]) if pieces else x)
            yield b.set_column(at, b.schema.field(at), pa.array(done, pa.string()))

    out = inner.mapInArrow(tidy(run), T.StructType(fields)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
