"""Personal data by shapes, and by bootstrapped context.

Shapes (email, ip, card, phone) give the base spans.  A base span as a whole is a
seed instance.  Other instances are the whitespace-parted tokens with a digit or
an @ that touch no base span, less the signs at their ends; groups of digits (and
capitals) with single spaces between, up to six, are one instance, as they are in
cards and phone numbers, so that pieces of an identifier don't stand for others.
Instances of too few letters and digits to identify anyone (see LEAST) are
counterexamples.  The two
words before an instance, the word before with the one after, and the two words
after are its lexical patterns (lower case, digits as 0, without signs).

Rounds over the graph of patterns and distinct instances score each by the other:
a pattern by the scores of its instances that reach the bar, over their sum plus
its counterexamples, a share of what is still unknown, and what chance allows;
an instance by the chance that not all its confident patterns err.  Instances
found count as seeds do from the next round on, so that a pattern without seeds
can become confident.  Scores only rise, so the rounds end, when none does.  What
reaches the bar is added as spans of kind context.

Everything is DataFrame expressions.  Spark has no function for the places of
matches; they come from the lengths of the pieces between and of the matches,
summed in two levels, so that a text with very many matches stays cheap.

Defined cases: a null text is empty; repeated rows and doc_ids are separate
documents, though only distinct instances count in scores; an instance is the
same wherever it stands; an empty table gives an empty result; other columns are
ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorframe.llm.common import discard, materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored forms that match what the plain ones do, in linear time:
# a run is entered at its start only, or where the match before ended (\G).
_USER = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_USER}])|\G)[{_USER}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for its pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_S = r"[^\x20\x09-\x0D]"
#: Of a spaced identifier, a group: capitals, digits and signs with a digit among them.
_GROUP = r"[A-Z(+]*+[0-9][A-Z0-9()./-]*+"
INSTANCE = rf"(?<!{_S})(?:{_GROUP}(?:\x20{_GROUP}){{1,5}}[^A-Za-z0-9\x20\x09-\x0D]*+(?!{_S})|{_S}*?[0-9@]{_S}*+)"
CONTEXT = 64
#: Letters and digits, and digits, that an instance must have not to be a counterexample.
LEAST = (6, 3)
#: Distinct instances that a pattern needs, and what of an unknown one and of chance counts against it.
SUPPORT, UNKNOWN, DISCOUNT = 3, 0.05, 0.5
PATTERN_BAR, INSTANCE_BAR = 0.8, 0.8
WIDE = 128
#: Rows of one key that a join leaves together, and places that more are dealt over at most.
TOGETHER, PLACES = 1000, 32
INTS = "array<int>"


def located(d: DataFrame, found: dict[str, tuple[str, Column]]) -> DataFrame:
    """d (with text t) and, by name, array<struct<start, end, match, before, after, prev, next>> of the matches of (pattern, condition).

    before and after are the texts since the last match and up to the next, prev and
    next those matches.  Each step is a projection of its own: an expression that
    is used twice, or in a lambda, would be evaluated as often.
    """
    strings = F.array().cast("array<string>")
    d = d.withColumns({f"{k}_f": F.when(has, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(strings) for k, (p, has) in found.items()} | {f"{k}_p": F.when(has, F.split("t", p, -1)).otherwise(F.array(F.lit(""))) for k, (p, has) in found.items()})
    d = d.withColumns({f"{k}_n": F.size(f"{k}_f") for k in found})
    d = d.withColumns({f"{k}_l": F.zip_with(f"{k}_f", F.slice(f"{k}_p", F.lit(1), F.col(f"{k}_n")), lambda m, b: F.length(m) + F.length(b)) for k in found})
    step = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out"))
    fold = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("total"), F.array().cast(INTS).alias("out")), step)
    firsts = lambda k: F.when(F.col(f"{k}_n") > 0, F.sequence(F.lit(1), F.col(f"{k}_n"), F.lit(WIDE))).otherwise(F.array().cast(INTS))
    parts = lambda k: F.transform(firsts(k), lambda s: fold(F.slice(f"{k}_l", s, WIDE)))
    d = d.withColumns({f"{k}_s": parts(k) for k in found})
    d = d.withColumns({f"{k}_o": fold(F.transform(f"{k}_s", lambda p: p["total"]))["out"] for k in found})
    d = d.withColumns({f"{k}_a": F.flatten(F.zip_with(f"{k}_s", f"{k}_o", lambda p, o: F.transform(p["out"], lambda x: x + o))) for k in found})

    def row(k: str) -> Column:
        n, m, p = F.col(f"{k}_n"), F.col(f"{k}_f"), F.col(f"{k}_p")
        fewer = F.greatest(n - 1, F.lit(0))
        columns = {"at": F.col(f"{k}_a"), "match": m, "before": F.slice(p, F.lit(1), n), "after": F.slice(p, F.lit(2), n), "prev": F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), fewer)), "next": F.concat(F.slice(m, F.lit(2), fewer), F.array(F.lit("")))}
        both = F.filter(F.arrays_zip(*[c.alias(name) for name, c in columns.items()]), lambda x: x["match"].isNotNull())
        return F.transform(both, lambda x: F.struct(
            (x["at"] + F.length(x["before"])).alias("start"), (x["at"] + F.length(x["before"]) + F.length(x["match"])).alias("end"),
            *[x[c].alias(c) for c in ("match", "before", "after", "prev", "next")],
        ))

    return d.withColumns({k: row(k) for k in found}).drop(*[f"{k}_{c}" for k in found for c in "fpnlsoa"])


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(F.when(digit(i) * 2 > 9, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _has(kind: str) -> Column:
    return F.contains(F.col("t"), F.lit(NEEDS[kind])) if kind in ("email", "phone") else F.col("t").rlike(NEEDS[kind])


SPAN = "array<struct<start:int,end:int>>"


def _instance(x: Column, label: Column, lead: Column | int = 0, tail: Column | int = 0, text: Column | None = None) -> Column:
    """A match less its first and last code points, with the texts beside it."""
    return F.struct(
        (x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), (x["match"] if text is None else text).alias("instance"), label.alias("label"),
        F.right(F.concat(F.right(x["prev"], F.lit(CONTEXT)), x["before"]), F.lit(CONTEXT)).alias("left"), F.left(F.concat(x["after"], F.left(x["next"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("right"),
    )


def found(docs: DataFrame) -> DataFrame:
    """rid, doc_id, a span array for each kind, and the instances (start, end, instance, label, left, right).

    label is 1 for seeds, -1 for counterexamples and 0 for what is unknown.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = located(d, {k: (PATTERNS[k], _has(k)) for k in KINDS} | {"token": (INSTANCE, F.col("t").rlike("[0-9@]"))})
    held = lambda k: F.filter(k, lambda x: _holds(k, x["match"]))
    d = d.withColumns({k: held(k) for k in KINDS})
    lead = lambda x: F.length(F.regexp_extract(x["match"], "^[^A-Za-z0-9+]+", 0))
    tail = lambda x: F.length(F.regexp_extract(x["match"], "[^A-Za-z0-9]+$", 0))
    inner = lambda x: F.regexp_replace(x["match"], "^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    few = lambda x: (F.length(F.regexp_replace(x["match"], "[^A-Za-z0-9]", "")) < LEAST[0]) | (F.length(F.regexp_replace(x["match"], "[^0-9]", "")) < LEAST[1])
    tokens = F.transform("token", lambda x: _instance(x, F.when(few(x), -1).otherwise(0), lead(x), tail(x), inner(x)))
    seeds = F.concat(*[F.transform(k, lambda x: _instance(x, F.lit(1))) for k in KINDS])
    d = d.withColumn("instances", F.concat(seeds, F.filter(tokens, lambda x: x["start"] < x["end"])))
    spans = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS]
    return d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *spans, "instances")


def mentions(found_in: DataFrame) -> DataFrame:
    """(rid, start, end, instance, label, left, right): seeds, and other instances that touch no base span."""
    each = found_in.select("rid", F.explode("instances").alias("x")).select("rid", "x.*")
    seed = F.col("label") == 1
    up = Window.partitionBy("rid").orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    # A seed that starts with a token comes after it here.
    down = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("label")).rowsBetween(Window.unboundedPreceding, -1)
    far, near = F.max(F.when(seed, F.col("end"))).over(up), F.min(F.when(seed, F.col("start"))).over(down)
    apart = each.withColumn("far", far).withColumn("near", near)
    return apart.filter(seed | (F.coalesce(F.col("far") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("near") >= F.col("end"), F.lit(True)))).drop("far", "near")


def patterns_of(left: Column, right: Column) -> Column:
    """The patterns of a place, by the texts beside it."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"[^\p{L}\p{N}\s]+", "")
    last, first = r"(\S+)\s*$", r"^\s*(\S+)"
    one, two = F.regexp_extract(plain(left), last, 1), F.regexp_extract(plain(left), r"(\S+\s+\S+)\s*$", 1)
    next_, after = F.regexp_extract(plain(right), first, 1), F.regexp_extract(plain(right), r"^\s*(\S+\s+\S+)", 1)
    single = lambda c: F.regexp_replace(c, r"\s+", " ")
    shapes = [(two != "", F.concat(single(two), F.lit(" _"))), ((one != "") & (next_ != ""), F.concat(one, F.lit(" _ "), next_)), (after != "", F.concat(F.lit("_ "), single(after)))]
    return F.array_compact(F.array(*[F.when(on, p) for on, p in shapes]))


def places(n: Column) -> Column:
    """How many places n rows of one key are dealt over."""
    return F.least(F.expr("1L") + F.floor(n / TOGETHER), F.lit(PLACES))


def dealt_join(rows: DataFrame, by_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, which says in n how many rows a key has, or more.

    Only keys of many rows are dealt over several places, by their other columns, each with
    a copy of the key's row: the copies are fewer than the keys and a thousandth of n together.
    Such keys are few, a thousandth of n at most, and are broadcast.
    """
    many = F.broadcast(by_key.filter(F.col("n") >= TOGETHER).select(key, places(F.col("n")).alias("_places")))
    salt = F.when(F.col("_places").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_places")))
    salted = rows.join(many, key, "left").withColumn("_salt", salt).drop("_places")
    copies = by_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), places(F.col("n")) - 1))).drop("n")
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def confident(mentioned: DataFrame) -> DataFrame:
    """Instances (not seeds) that the graph's rounds bring to the bar.

    mentioned: (pattern, instance, label).  An instance that is a seed anywhere is one everywhere.
    """
    known = materialize(mentioned.groupBy("instance").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n")), "known")
    edges = materialize(dealt_join(mentioned.select("pattern", "instance").distinct(), known, "instance"), "mentions")
    # Counterexamples never change, so they are counted once; patterns of too few instances can't become confident.
    patterns = edges.groupBy("pattern").agg(F.sum((F.col("label") < 0).cast("int")).alias("against"), F.sum((F.col("label") >= 0).cast("int")).alias("n")).filter(F.col("n") >= SUPPORT)
    patterns = materialize(patterns, "patterns")
    edges = materialize(dealt_join(edges.filter("label >= 0"), patterns.select("pattern", "n"), "pattern", "left_semi"), "edges")
    scores, risen = edges.groupBy("instance").agg(F.max("label").cast("double").alias("score"), F.count(F.lit(1)).alias("n")), 0.0
    while True:
        scored = dealt_join(edges.select("pattern", "instance"), scores, "instance")
        sums = scored.filter(F.col("score") >= INSTANCE_BAR).groupBy("pattern").agg(F.sum("score").alias("for"), F.count(F.lit(1)).alias("held")).filter(F.col("held") >= SUPPORT)
        chosen = sums.join(patterns, "pattern").withColumn("confidence", F.col("for") / (F.col("for") + F.col("against") + UNKNOWN * (F.col("n") - F.col("held")) + DISCOUNT)).filter(F.col("confidence") >= PATTERN_BAR)
        raised = dealt_join(edges, chosen.select("pattern", "confidence", "n"), "pattern").filter("label = 0").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("raised"))
        before, scores = scores, materialize(scores.join(raised, "instance", "left").select("instance", F.greatest("score", F.round(F.coalesce("raised", F.lit(0.0)), 6)).alias("score"), "n"), "scores")
        discard(before)
        total = scores.agg(F.sum(F.col("score").cast("decimal(20,6)"))).first()[0] or 0
        if total == risen:
            break
        risen = total
    return scores.filter(F.col("score") >= INSTANCE_BAR).join(known.filter("label = 0"), "instance", "left_semi").select("instance")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind and for context, an array of spans."""
    d = materialize(found(docs), "private")
    each = materialize(mentions(d), "instances")
    chosen = confident(each.select(F.explode(patterns_of(F.col("left"), F.col("right"))).alias("pattern"), "instance", "label"))
    hits = each.filter("label = 0").select("rid", "start", "end", "instance")
    chosen = chosen.join(hits.groupBy("instance").agg(F.count(F.lit(1)).alias("n")), "instance")
    added = dealt_join(hits, chosen, "instance", "left_semi").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("context"))
    return d.drop("instances").join(added, "rid", "left").withColumn("context", F.coalesce("context", F.array().cast(SPAN))).drop("rid")


def digests(docs: DataFrame) -> DataFrame:
    def shown(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    line = lambda kinds: F.array_join(F.concat(*map(shown, kinds)), ",")
    return scan(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(line(KINDS), 256).alias("base_sha256"), line((*KINDS, "context")).alias("spans"), sum((F.size(k) for k in (*KINDS, "context")), F.lit(0)).cast("long").alias("n_spans"))
