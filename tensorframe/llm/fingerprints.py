"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

Sections are parted by empty lines, paragraphs by line ends; a paragraph's
leaves are runs of at most 24 code points that also end with a sentence, so that
an edit disturbs its own sentence only.  Every node's hash is the MD5 of its
children's hashes and the root's tells whether texts are equal.  The fingerprint
prints the tree down to paragraphs (root:section(paragraph,…);…, hashes below the
root shortened).  Cutting loses no character, so only equal texts (or MD5
collisions) have equal roots; of unequal ones the trees are descended from the
root to the paragraphs that differ, which locates an edit in either text.

Likeness is Dice's coefficient of two trees' distinct leaves, which `fingerprint`
gives as a column of their own if asked; equal roots give 1.

Defined cases: a null text is the empty text; rows with one doc_id are ordered by
a hash of the text, null ids first; the row after the last is the first, also
when it is the only one; an empty table gives an empty result; other columns are
ignored.  Everything is DataFrame expressions; the texts are shuffled once, by
ranges of doc_id whose bounds (a few per shuffle partition) come from quantiles.
An id that fills more than one range, as null may, is cut by the texts' hashes;
only rows alike in id and text must share a range.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorframe.llm.common import buckets

LEAF = r"[^.!?]{0,24}[.!?]+|[^.!?]{1,24}"
SHORT = 8
LEAST = -(2**63)
#: Hexadecimal digits of a text's hash that count for its place.
DIGITS = 15


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes."""
    leaves = lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), F.md5)
    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), leaves))


def printed(nodes: Column) -> Column:
    """root:section(paragraph,…);… as one string."""
    paragraph_hash = lambda leaves: F.md5(F.array_join(leaves, ""))
    section_hash = lambda section: F.md5(F.array_join(F.transform(section, paragraph_hash), ""))
    short = lambda x: F.substring(x, 1, SHORT)
    show_paragraph = lambda leaves: short(paragraph_hash(leaves))
    show_section = lambda section: F.concat(short(section_hash(section)), F.lit("("), F.array_join(F.transform(section, show_paragraph), ","), F.lit(")"))
    root = F.md5(F.array_join(F.transform(nodes, section_hash), ""))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(nodes, show_section), ";"))


def distinct_leaves(nodes: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda x: F.substring(x, 1, SHORT)))


def likeness(a_print: Column, a_leaves: Column, b_print: Column, b_leaves: Column) -> Column:
    shared = F.size(F.array_intersect(a_leaves, b_leaves))
    return F.when(F.substring(a_print, 1, 32) == F.substring(b_print, 1, 32), 1.0).otherwise(2.0 * shared / F.greatest(F.size(a_leaves) + F.size(b_leaves), F.lit(1)))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", leaves: str | None = None) -> DataFrame:
    """docs with the printed tree of each text, and its distinct leaves if a column is named for them."""
    nodes = tree(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns({out: printed(nodes)} | ({leaves: distinct_leaves(nodes)} if leaves else {}))


def _mismatch(a: Column, b: Column) -> Column:
    """How many nodes two lists have in common before they first differ."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def _apart(a: Column, b: Column) -> Column:
    """from and to (counted from 1) of the nodes of a that lie between what both lists begin with and end with; to is before from if b only has more."""
    head = F.array(F.struct(a.alias("a"), b.alias("b"), _mismatch(a, b).alias("head")))
    tail = F.transform(head, lambda x: F.struct(x["head"].alias("head"), F.least(_mismatch(F.reverse(x["a"]), F.reverse(x["b"])), F.least(F.size(x["a"]), F.size(x["b"])) - x["head"]).alias("tail"), F.size(x["a"]).alias("n")))
    return F.transform(tail, lambda x: F.struct((x["head"] + 1).alias("from"), (x["n"] - x["tail"]).alias("to")))[0]


def _sections(fp: Column) -> Column:
    return F.split(F.substring(fp, 34, 2**31 - 1), ";")


def _paragraphs(section: Column) -> Column:
    return F.split(F.regexp_extract(section, r"\((.*)\)", 1), ",")


def differing(a: Column, b: Column) -> Column:
    """Where the tree printed as a differs from that printed as b: branches "section.paragraph-paragraph", counted from 1.

    Both are descended from their roots: equal roots have no differing branch;
    else sections that both begin or end with are left out, and those between are
    descended in pairs, in order, to their paragraphs, of which again those that
    both begin or end with are left out.  "s.f-t" with t before f: between t and f
    the other has more; a section without a partner is "s".
    """
    span = F.array(F.struct(_sections(a).alias("a"), _sections(b).alias("b")))
    span = F.transform(span, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _apart(x["a"], x["b"]).alias("own"), _apart(x["b"], x["a"]).alias("other")))

    def branch(x: Column, i: Column) -> Column:
        pair = F.transform(F.array(_apart(_paragraphs(F.get(x["a"], i - 1)), _paragraphs(F.get(x["b"], i - 1)))), lambda y: F.concat_ws("", i.cast("string"), F.lit("."), y["from"].cast("string"), F.lit("-"), y["to"].cast("string")))[0]
        return F.when(i <= x["other"]["to"], pair).otherwise(i.cast("string"))

    def branches(x: Column) -> Column:
        to = x["own"]["to"]
        some = F.when(to >= x["own"]["from"], F.sequence(x["own"]["from"], to)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda i: branch(x, i))

    found = F.flatten(F.transform(span, branches))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast("array<string>")).otherwise(found)


def _place(key: Column, h: Column) -> Column:
    """A string that sorts as (key, h) do: the key's hexadecimal digits, counted from the least long, and the first of the hash."""
    return F.concat(F.lpad(F.hex(key.bitwiseXOR(F.lit(LEAST))), 16, "0"), F.substring(h, 1, DIGITS))


def _cuts(keys: DataFrame, n: int) -> list[str]:
    """Places at which ranges of about as many rows start, at most n."""
    found = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    out = []
    for key, times in Counter(found or ()).items():
        # A key that is there d times fills d - 1 ranges at least: its hashes are cut alike.
        prefix = f"{(key - LEAST):016X}"
        out += [prefix + f"{(i << 4 * DIGITS) // times:0{DIGITS}x}" for i in range(times)]
    return sorted(out)


def _bucket(place: Column, cuts: list[str]) -> Column:
    """Number of cuts up to the place: a search in two levels, as cuts can be many."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    up_to = lambda values: F.size(F.filter(values, lambda c: c <= place))
    coarse = up_to(F.lit([g[0] for g in groups]))
    fine = up_to(F.element_at(F.lit(groups), F.greatest(coarse, F.lit(1))))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the leaves of the text, and the same of the next row as next_text and next_leaves.

    Each range of places goes to one window; the first rows of a range are also
    sent, marked, to the range before, whose last row looks at them.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"))
    rows = rows.withColumn("h", F.md5("text"))
    rows = rows.withColumn("at", _place(F.col("key"), F.col("h")))
    found = rows.groupBy(_bucket(F.col("at"), _cuts(rows.select("key"), buckets(docs.sparkSession))).alias("bucket")).agg(F.min("at").alias("least")).collect()
    bounds = sorted(r.least for r in found)
    cuts = bounds[1:]  # each is a place that exists, the least of its range
    number = _bucket(F.col("at"), cuts)
    last = len(cuts)
    before = F.when(F.col("at") == bounds[0], last).otherwise(number - 1) if last else F.lit(0)
    firsts = F.col("at") == F.element_at(F.lit(bounds), number + 1) if bounds else F.lit(False)
    places = F.when(firsts, F.array(F.struct(number.alias("bucket"), F.lit(False).alias("guest")), F.struct(before.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(number.alias("bucket"), F.lit(False).alias("guest"))))
    order = Window.partitionBy("bucket").orderBy("guest", "at", "h", "text")
    dealt = (
        rows.withColumn("place", F.explode(places)).select("doc_id", "at", "h", "text", F.col("place.bucket").alias("bucket"), F.col("place.guest").alias("guest"))
        .repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    )
    nodes = dealt.withColumn("nodes", tree(F.col("text")))
    return (
        nodes.withColumn("next_text", F.lead("text").over(order)).withColumn("next_nodes", F.lead("nodes").over(order))
        .filter(~F.col("guest")).select("doc_id", "text", "nodes", "next_text", "next_nodes")
    )


def edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, its edited text's, and how like they and the next document's are.

    The edit replaces the last quarter of the code points by as many (or all) of
    the first ones of the next document.
    """
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 4))"), F.expr("substring(next_text, 1, int(length(text) div 4))"))
    d = with_next(docs).withColumn("edited", edited)
    d = d.withColumn("edited_nodes", tree(F.col("edited")))
    d = d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("nodes")).alias("fingerprint"), printed(F.col("edited_nodes")).alias("edited_fingerprint"), printed(F.col("next_nodes")).alias("next_fingerprint"),
        distinct_leaves(F.col("nodes")).alias("a"), distinct_leaves(F.col("edited_nodes")).alias("b"), distinct_leaves(F.col("next_nodes")).alias("c"),
    )
    return d.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("a"), F.col("edited_fingerprint"), F.col("b")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("a"), F.col("next_fingerprint"), F.col("c")).alias("near_next"),
        F.array_join(differing(F.col("fingerprint"), F.col("edited_fingerprint")), ",").alias("differs"),
        F.array_join(differing(F.col("edited_fingerprint"), F.col("fingerprint")), ",").alias("edited_differs"),
    )


_TREE = f"""list_transform(string_split(x.t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: md5(l))))"""
_PRINTED = """md5(array_to_string(list_transform(tree, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), '')) || ':' ||
  array_to_string(list_transform(tree, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))[1:8] || '(' ||
    array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))[1:8]), ',') || ')'), ';')"""



def _differs(a: str, b: str) -> str:
    """SQL of differing() of two printed trees, joined."""
    mismatch = lambda x, y: f"(coalesce(list_position(list_transform(range(1, greatest(len({x}), len({y})) + 1), lambda k: {x}[k] IS DISTINCT FROM {y}[k]), true), len({x}) + 1) - 1)"
    tail = lambda x, y: f"least({mismatch(f'list_reverse({x})', f'list_reverse({y})')}, least(len({x}), len({y})) - {mismatch(x, y)})"
    sections = lambda x: f"string_split({x}[34:], ';')"
    paragraphs = lambda x: f"string_split(regexp_extract({x}, '\\((.*)\\)', 1), ',')"
    x, y = sections(a), sections(b)
    p, q = paragraphs(f"{x}[i]"), paragraphs(f"{y}[i]")
    pair = f"i || '.' || ({mismatch(p, q)} + 1) || '-' || (len({p}) - {tail(p, q)})"
    each = f"list_transform(range({mismatch(x, y)} + 1, len({x}) - {tail(x, y)} + 1), lambda i: CASE WHEN i <= len({y}) - {tail(x, y)} THEN {pair} ELSE i::VARCHAR END)"
    return f"CASE WHEN {a}[1:32] = {b}[1:32] THEN '' ELSE coalesce(array_to_string({each}, ','), '') END"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, '')), coalesce(text, '')) AS n, count(*) OVER () AS m FROM documents),
e AS (SELECT a.doc_id, a.n, length(a.t) AS n_chars, a.t, b.t AS next_t,
        a.t[1:length(a.t) - length(a.t) // 4] || b.t[1:length(a.t) // 4] AS edited
      FROM d a JOIN d b ON b.n = a.n % a.m + 1),
x AS (SELECT n, 0 AS kind, t FROM e UNION ALL SELECT n, 1, edited FROM e UNION ALL SELECT n, 2, next_t FROM e),
f AS (SELECT n, kind, {_TREE} AS tree FROM x),
p AS (SELECT n, kind, {_PRINTED} AS fp, list_distinct(list_transform(flatten(flatten(tree)), lambda l: l[1:8])) AS leaves FROM f)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.fp[1:32] = b.fp[1:32] THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, b.leaves)) / greatest(len(a.leaves) + len(b.leaves), 1) END AS near_edited,
  CASE WHEN a.fp[1:32] = c.fp[1:32] THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, c.leaves)) / greatest(len(a.leaves) + len(c.leaves), 1) END AS near_next,
  {_differs("a.fp", "b.fp")} AS differs, {_differs("b.fp", "a.fp")} AS edited_differs
FROM e JOIN p a ON a.n = e.n AND a.kind = 0 JOIN p b ON b.n = e.n AND b.kind = 1 JOIN p c ON c.n = e.n AND c.kind = 2
"""
