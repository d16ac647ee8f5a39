"""Information-theoretic sanitisation of personal data, with DataFrame and SQL functions only.

Base patterns find the protected entities: e-mail addresses, IP addresses, card numbers and phone numbers. Terms
(words of three letters or more outside entities) in a text that holds an entity may reveal it, wherever they stand.
Counts over distinct texts estimate how much: with N texts, n(e) of them holding the entity, n(t) the term and n(t, e)
both, the pointwise mutual information log2(n(t,e) N / (n(t) n(e))) is divided by the entity's own information
log2(N / n(e)). The quotient is 1 if the term occurs nowhere else, and about 0 if it is independent. A term that
reaches `GENERALISE` is generalised wherever it stands in a text with the entity, and removed if it reaches `REMOVE`.
Support: the texts with both must show the entity in at least `SUPPORT` different surroundings (`WINDOW` code points on
each side), as every word of a text is bound to an entity that occurs in one place only. Entities become their kind.

Patterns are written with possessive quantifiers and look-behind so that matching is linear in the text; they match
what the plain patterns match, leftmost and without overlap. Cutting is linear too: texts are taken apart once, and
each span reads the parts around it.

Scale: texts are shuffled once to count copies as one, and once more, with their spans, to meet their terms. Terms are
paired only with entities of enough surroundings, as no other pair can have the support; pairs and counts are
aggregated before their shuffles. Hot texts, entities and terms are joined by joins that split hot keys; nothing is
broadcast or collected but the number of texts.

Defined results: null text is empty for the counts and stays null when rewritten; an empty table gives an empty
result; repeated rows get the same spans; columns of any name are carried along; spans that overlap are rewritten as
one, named after the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import Scratch, cut
from reelquery.llm.components import spread_join

KINDS = ("email", "ip", "card", "phone", "term", "gone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",  # shorter ones fail, and no part of them has as many digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the pattern at all.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points on each side of an entity that are its surroundings; how many of them a term must have; disclosure to generalise, to remove.
WINDOW, SUPPORT, GENERALISE, REMOVE = 48, 3, 0.85, 0.97
_TERM = r"[\p{L}][\p{L}\p{N}_]{2,}+"
_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


#: Running values are computed in parts of so many, as what grows by appending costs the square of its length.
PART = 128


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


#: Places of a text are read by way of parts of so many code points, as `substring` walks from the text's beginning.
CHUNK = 256
#: With more disclosing terms than this, a text's words look for theirs among those of a hash slot.
FEW_TERMS = 32


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _between(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the text that has these parts; costs their number and two parts at most."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    within = F.substring(part(i), a % CHUNK + 1, b - a)
    over = F.concat(F.substring(part(i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(part(j), F.lit(1), b % CHUNK))
    return F.when(b <= a, F.lit("")).when(i == j, within).otherwise(over)


def _before(values: Column, combine) -> Column:
    """For each of an array of whole numbers, what `combine` makes of 0 and all before it."""

    def run(v: Column, start: Column) -> Column:
        return F.aggregate(v, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def parted(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda i: F.slice(v, i * PART + 1, PART))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, run(F.transform(p, lambda c: F.aggregate(c, F.lit(0), combine)), F.lit(0)), lambda c, start: F.when(c.isNotNull(), F.slice(run(c, start), 1, F.size(c))).otherwise(F.array().cast("array<int>")))))

    return _let(values, lambda v: F.when(F.size(v) <= PART, run(v, F.lit(0))).otherwise(parted(v)))


def _matches(text: Column, pattern: str, each) -> Column:
    """each(start, end, match) of the leftmost matches without overlap, in code points."""
    gaps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, v: F.struct(F.length(gap).alias("g"), v.alias("v")))

    def placed(pairs: Column) -> Column:
        before = _before(F.transform(pairs, lambda x: x["g"] + F.length(x["v"])), lambda a, b: a + b)
        return F.zip_with(pairs, F.slice(before, 1, F.size(pairs)), lambda x, p: each(p + x["g"], p + x["g"] + F.length(x["v"]), x["v"]))

    return _let(F.filter(gaps, lambda x: x["v"].isNotNull()), placed)


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches without overlap as structs (s, k, e, v); s and e in code points."""
    return _matches(text, pattern, lambda s, e, v: F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), v.alias("v")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _good(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    n = F.length(_digits(v))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(v))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _keeps(kind: str):
    return lambda x: _good(kind, x["v"])


def base_spans(text: Column) -> Column:
    """All base matches of a non-null text that hold, by start and then kind."""
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        may = text.rlike("[0-9](?:[\\x20-]?[0-9]){11}") if _HINT[kind] is None else text.contains(_HINT[kind])
        own = found(text, PATTERNS[kind], k)
        if kind != "email":
            own = F.filter(own, _keeps(kind))
        parts.append(F.when(may, own).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


def _name(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat(_name(x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with a space for each code point of a span."""
    return _replaced(text, spans, lambda x, p: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], p), F.lit(0))))


def _words(masked: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(_TERM), F.lit(0)), F.lower))


def _kinds_at(masked: Column, terms: Column) -> Column:
    """Spans of the terms (structs term, k) in a text; k is the term's."""
    n = F.when(F.size(terms) <= FEW_TERMS, 1).otherwise(F.ceil(F.sqrt(F.size(terms)))).cast("int")

    def placed(n: Column, slots: Column) -> Column:
        def own(s: Column, e: Column, v: Column) -> Column:
            near = F.element_at(slots, _slot(F.lower(v), n) + 1)
            return F.transform(F.filter(near, lambda t: t["term"] == F.lower(v)), lambda t: F.struct(s.alias("s"), t["k"].alias("k"), e.alias("e"), F.lit("").alias("v")))

        return F.flatten(_matches(masked, _TERM, own))

    slots = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(terms, lambda t: _slot(t["term"], n) == i))
    return _let(n, lambda n: _let(slots(n), lambda x: placed(n, x)))


def _slot(term: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(term), n)).cast("int")


def _entities(texts: DataFrame) -> DataFrame:
    """doc, entity and around (a hash of its surroundings) of each entity of the distinct texts (doc, text, base)."""

    def own(x: Column, parts: Column) -> Column:
        named = F.xxhash64(_name(x["k"]), F.when(x["k"] == 0, F.lower(x["v"])).otherwise(_digits(x["v"])))
        before = _between(parts, F.greatest(x["s"] - WINDOW, F.lit(0)), x["s"])
        return F.struct(named.alias("entity"), F.xxhash64(before, _between(parts, x["e"], x["e"] + WINDOW)).alias("around"))

    # Surroundings are cut before the entities become rows, so that no row of an entity carries the text.
    all_own = _let(_parts(F.col("text")), lambda parts: F.transform("base", lambda x: own(x, parts)))
    return texts.where(F.size("base") > 0).select("doc", F.explode(all_own).alias("x")).select("doc", "x.entity", "x.around").distinct()


def text_key(text: Column) -> Column:
    """What stands for a text: two hashes of different seeds, 128 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def disclosures(rows: DataFrame, *, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """doc (as given, see `text_key`), term and disclosure of each term that reaches the threshold for an entity of that text; rows have doc, text and base."""
    scratch = Scratch(rows.sparkSession)
    texts = rows.select("doc", "text", "base").dropDuplicates(["doc"])
    seen = scratch.keep(texts.select("doc", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"), _words(_masked(F.col("text"), F.col("base"))).alias("words")))
    total = float(max(seen.count(), 1))
    held = scratch.keep(_entities(seen))
    often = held.select("entity", "around").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("entity")
    placed = scratch.keep(spread_join(held, often, "entity"))
    own = placed.select("entity", "doc").distinct()
    holding = own.groupBy("entity").agg(F.count(F.lit(1)).alias("ne"))
    both = spread_join(placed.groupBy("doc", "entity").agg(F.collect_set("around").alias("arounds")), seen.where(F.size("base") > 0).select("doc", "words"), "doc")
    both = both.select("doc", "entity", "arounds", F.explode("words").alias("term"))
    joint = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("nte"))
    counts = seen.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    scored = spread_join(spread_join(joint, holding, "entity"), counts, "term")
    bits = F.greatest(F.log2(F.lit(total) / F.col("ne")), F.lit(1e-9))
    share = F.log2(F.col("nte") * total / (F.col("nt") * F.col("ne"))) / bits
    reach = scored.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold)
    places = both.select("entity", "term", F.explode("arounds").alias("around")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= support)
    reach = reach.join(places.select("entity", "term"), ["entity", "term"], "left_semi")
    pair = F.xxhash64("entity", "term").alias("pair")
    found_terms = spread_join(both.select("doc", "term", pair), reach.select(pair, "disclosure"), "pair")
    out = cut(found_terms.groupBy("doc", "term").agg(F.max("disclosure").alias("disclosure")))
    scratch.drop()
    return out


def spans_of(docs: DataFrame, *, text: str = "text", carry: list[str], with_text: bool) -> DataFrame:
    """Per row: the carried columns (as `__row`), base (base spans), spans (all of them, by start and then kind) and, if asked for, text."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = F.col("text")
    rows = rows.select("__row", "text", text_key(t).alias("doc"), F.when(t.contains("@") | t.rlike("[0-9]"), base_spans(t)).otherwise(_none()).alias("base"))
    kinds = F.struct("term", F.when(F.col("disclosure") >= REMOVE, F.lit(5)).otherwise(F.lit(4)).alias("k"))
    terms = disclosures(rows).groupBy("doc").agg(F.collect_set(kinds).alias("terms"))
    out = spread_join(rows, terms, "doc", "left")
    more = F.when(F.col("terms").isNull(), _none()).otherwise(_kinds_at(_masked(t, F.col("base")), F.col("terms")))
    return out.select("__row", "base", F.array_sort(F.concat("base", more)).alias("spans"), *(["text"] if with_text else []))


def _replaced(text: Column, spans: Column, label) -> Column:
    """The text with `label(span, how far those before reach)` for each span (sorted by start); what lies between is kept."""

    def made(own: Column, parts: Column) -> Column:
        reach = _before(F.transform(own, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(own, F.slice(reach, 1, F.size(own)), lambda x, p: F.concat(_between(parts, p, x["s"]), label(x, p)))
        last = F.array_max(F.transform(own, lambda x: x["e"]))
        return F.concat(F.array_join(pieces, ""), _let(last, lambda p: _between(parts, p, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, lambda own: _let(_parts(text), lambda parts: made(own, parts))))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; removed terms leave nothing."""
    return _replaced(text, spans, lambda x, p: F.when((x["k"] == 5) | (x["s"] < p), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(_name(x["k"])), F.lit("]"))))


def sanitize(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with entities replaced by their kind and disclosing terms generalised or removed; n_chars, if there, follows."""
    found_spans = spans_of(docs, text=text, carry=docs.columns, with_text=True).withColumn("new", rewritten(F.col("text"), F.col("spans")))
    was = F.col(f"__row.`{text}`")
    columns = []
    for c in docs.columns:
        old = F.col(f"__row.`{c}`")
        if c == text:
            columns.append(F.when(was.isNotNull(), F.col("new")).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.size("spans") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return found_spans.select(*columns)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = spans_of(docs, carry=["doc_id"], with_text=False)
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return out.select(
        F.col("__row.doc_id").alias("doc_id"),
        *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
