"""Personal data: spans by patterns of form, and a bootstrap over contexts that finds unseen identifiers.

*Forms.* E-mail addresses, IP addresses, card and phone numbers are found by regular expressions, leftmost and
without overlap for each kind, and checked (parts of an address, Luhn's sum, number of digits). Spark's
functions return the matches but not their places; a split by the same expression returns what lies
between, and running sums of both lengths are the places. The expressions start only where a run of
their characters starts and never give characters back, so that a text without a match is read once.

*Contexts.* Whatever else holds a digit or an at sign is a candidate, unless it overlaps such a span. Every span
and candidate has up to three lexical patterns: the two words before it, the two after it, and the one on either
side, in lower case, digits as 0.

*Bootstrap.* Spans are seeds. In the graph of patterns and values, a pattern's confidence for a kind is the
weight of its distinct values of that kind against those of other kinds, and a part (``UNKNOWN``) of those of none. A
pattern of at least ``SUPPORT`` values and ``CONFIDENT`` of weight is confident. A value's score is one less the
product of what its confident patterns leave open; at ``CONFIDENT`` it is taken for an identifier of that
kind, if its characters are among those of the kind's seeds and its length is within three times theirs. Such values
count in the next round, ``ROUNDS`` of them or until none is new. All their occurrences are returned.

Every distinct pattern and value counts once, so that copies of a text add nothing. All aggregates combine in the
tasks before they move; joins on patterns and values are salted, as one of them may be in a third of
all texts. Only the classes of characters of four kinds are broadcast.

Defined cases: a null text counts as empty and has no spans; rows that repeat an id are rows each, a null id is
kept; a text is read whole by one task, and its matches meet in one, whatever its length; of a context words
beyond ``CONTEXT`` characters are cut to these; an empty table gives an empty table; other columns are
ignored, whatever they are called. Places are in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: The kinds in their order. Each expression equals its plain form, but does not go back.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(FORMS)
#: Runs with a digit or an at sign, and groups of digits after single spaces.
CANDIDATE = r"(?<![A-Za-z0-9._%+@()-])[A-Za-z._%+()-]*+[0-9@][A-Za-z0-9._%+@()-]*+(?:\x20[0-9(][0-9().-]*+)*+"
#: What a text must hold for each of them.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "other": "[0-9@]"}
#: Characters of context on either side.
CONTEXT = 64
ROUNDS, SUPPORT, CONFIDENT, UNKNOWN = 3, 3, 0.8, 0.25
#: Parts that a hot pattern or value is cut into.
SALTS = 32


def _matches(text: Column, kind: str, form: str) -> Column:
    """array<(kind, gap, value, before, after)>: the matches, each with the length of the text since the one before it."""
    values, pieces = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    met = F.arrays_zip(values.alias("v"), F.slice(pieces, F.lit(1), F.size(values)).alias("b"), F.slice(pieces, F.lit(2), F.size(values)).alias("a"))
    found = F.transform(met, lambda m: F.struct(
        F.lit(kind).alias("kind"), F.length(m["b"]).cast("long").alias("gap"), m["v"].alias("value"),
        F.right(m["b"], F.lit(CONTEXT)).alias("before"), F.left(m["a"], F.lit(CONTEXT)).alias("after")))
    return F.when(F.rlike(text, F.lit(GATES[kind])), found).otherwise(F.array())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit that Luhn's rule gives it."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(numbers, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match passes the check of its kind."""
    n = F.length(_digits(value))
    parts = F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    return (F.when(kind == "ip", parts).when(kind == "card", F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False))
            .when(kind == "phone", n.between(9, 15)).otherwise(True))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, found): every row once with all matches of its text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = F.concat(*[_matches(F.col("text"), k, f) for k, f in (FORMS | {"other": CANDIDATE}).items()])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    return durable(rows.select("row", "doc_id", found.alias("found")))


def spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, before, after): checked spans of the four kinds, and candidates (kind other) that overlap none."""
    each = scanned.select("row", F.posexplode("found").alias("k", "m")).select("row", "k", "m.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("k")
    start = F.sum("gap").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("value")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    other = F.col("kind") == "other"
    trimmed = F.regexp_replace("value", r"[.-]+$", "")
    placed = each.withColumn("start", start).where(other | _holds(F.col("kind"), F.col("value"))).withColumn("value", F.when(other, trimmed).otherwise(F.col("value")))
    placed = placed.withColumn("end", F.col("start") + F.length("value"))
    base, so_far = ~other, (Window.unboundedPreceding, 0)  # frames that grow take linear time, those that shrink do not
    reached = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", other).rowsBetween(*so_far))
    ahead = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), other).rowsBetween(*so_far))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    marked = placed.withColumn("_free", base | (free & F.rlike("value", F.lit("[0-9@]"))))
    return durable(marked.where("_free").select("row", "kind", "start", "end", "value", "before", "after"))


def contexts(found: DataFrame) -> DataFrame:
    """(pattern, value, seed) once each; seed is the kind of a span, null for a candidate."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    before, after = F.filter(F.split(plain("before"), r"\s+"), lambda w: w != ""), F.filter(F.split(plain("after"), r"\s+"), lambda w: w != "")
    rows = found.select("kind", F.lower("value").alias("value"), before.alias("b"), after.alias("a"))
    last, next_ = F.try_element_at("b", F.lit(-1)), F.try_element_at("a", F.lit(1))
    kinds = F.array(
        F.concat(F.lit("<"), F.try_element_at("b", F.lit(-2)), F.lit(" "), last), F.concat(F.lit(">"), next_, F.lit(" "), F.try_element_at("a", F.lit(2))), F.concat(F.lit("="), last, F.lit(" "), next_))
    edges = rows.select(F.explode(F.filter(kinds, lambda p: p.isNotNull())).alias("pattern"), "value", F.when(F.col("kind") != "other", F.col("kind")).alias("seed"))
    return edges.groupBy("pattern", "value").agg(F.min("seed").alias("seed"))


def salted_join(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """A join whose keys, however hot in ``big``, are dealt into ``SALTS`` parts by another column."""
    copies = small.withColumn("_salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def classes(value: Column) -> Column:
    """The characters of a value, each once, letters as a and digits as 0."""
    return F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(value, r"\p{L}", "a"), "[0-9]", "0"), ""))


def seed_classes(found: DataFrame) -> DataFrame:
    """(kind, allowed, shortest, longest): one row for each kind that has seeds."""
    seeds = found.where(F.col("kind") != "other").select("kind", F.explode(classes(F.lower("value"))).alias("c"), F.length("value").alias("n"))
    return seeds.groupBy("kind").agg(F.collect_set("c").alias("allowed"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


def confident_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of edges (pattern, value, kind, score); a kind of null is unknown."""
    weights = edges.groupBy("pattern", "kind").agg(F.sum("score").alias("w"), F.count(F.when(F.col("score") >= CONFIDENT, 1)).alias("n"), F.sum(1 - F.col("score")).alias("open"))
    both = weights.groupBy("pattern").agg(
        F.sum("w").alias("all"), F.sum("open").alias("open"), F.max(F.when(F.col("kind").isNotNull(), F.struct("w", "kind", "n"))).alias("best"))  # a pattern stands for one kind: the heaviest
    confidence = F.col("best.w") / (F.col("all") + UNKNOWN * F.col("open"))
    return both.where((F.col("best.n") >= SUPPORT) & (confidence >= CONFIDENT)).select("pattern", F.col("best.kind").alias("kind"), F.round(confidence, 9).alias("confidence"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score): candidates that confident contexts make identifiers."""
    edges = durable(contexts(found))
    shapes = F.broadcast(durable(seed_classes(found)))
    known = edges.where(F.col("seed").isNotNull()).select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    unknown = edges.where(F.col("seed").isNull()).select("pattern", "value")
    taken, count = None, 0
    for _ in range(rounds):
        if taken is None:
            scored = unknown.select("pattern", "value", F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("score"))
        else:
            scored = salted_join(unknown, taken, "value", "pattern", "left").select("pattern", "value", "kind", F.coalesce("score", F.lit(0.0)).alias("score"))
        patterns = durable(confident_patterns(known.union(scored)))
        reached = salted_join(unknown, patterns, "pattern", "value").groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))), 9).alias("score"))
        best = reached.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score").where(F.col("score") >= CONFIDENT)
        fits = F.size(F.array_except(classes(F.col("value")), "allowed")) == 0
        sized = F.length("value").between(F.col("shortest") / 3, F.col("longest") * 3) & ((F.col("kind") == "email") == F.contains("value", F.lit("@")))
        taken = durable(best.join(shapes, "kind").where(fits & sized).select("value", "kind", "score"))
        if (now := taken.count()) == count:
            break
        count = now
    return taken


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra) for every row: arrays of (order, start, end), base by forms and extra by contexts, each in order."""
    scanned = scan(docs, id_col, text_col)
    found = spans(scanned)
    taken = bootstrap(found).select("value", "kind")
    others = found.where(F.col("kind") == "other").select("row", "start", "end", F.lower("value").alias("value"))
    extra = salted_join(others, taken, "value", "row").select("row", "kind", "start", "end", F.lit(False).alias("base"))
    base = found.where(F.col("kind") != "other").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    place = F.array_position(F.array([F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    each = base.union(extra).select("row", "base", F.struct(place.alias("order"), "start", "end").alias("s"))
    lists = each.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("base"), F.col("s")))).alias("extra"))
    none = F.array().cast("array<struct<order:int,start:bigint,end:bigint>>")
    return scanned.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"))


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array([F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["order"] == KINDS.index(kind) + 1)).cast("long")
