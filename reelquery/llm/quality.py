"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A text is measured once (`measures`: lengths, symbols, stop words, lines, repeated windows, all as whole numbers); a rule
bounds a ratio of two measures in per cent, and `compiled` turns a table of rules into one column that names the rules a
text fails. Comparisons are of whole numbers (100 * a against percent * b), so nothing depends on rounding. Everything is a
column expression of the row: no shuffle, no Python, one pass over the texts.

Repeated windows: hashes of every 8 consecutive words; only a text whose hashes aren't distinct sorts them with their
places, compares neighbours of equal hash word by word, and adds up what the windows cover, so the cost is that of a sort of
the text's words. (A repeat is overlooked only if a third, different window of the same text has the same 64-bit hash.)

The built-in rules follow public practice for web text (mean word length, symbol to word ratio, share of words with a letter,
bullet and ellipsis lines, repeated lines, stop words). Stop words are of four languages and their rule asks for
2 % only from 100 words on, as short clean texts may have none.

Defined results: a null text has no words and no lines, like an empty one, and is not kept; a line is what stands between
line feeds and counts if it holds a word; ratios over nothing are never failed; repeated rows are judged each by itself; a
column of the input named like the result column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import ROW

#: What separates words, and a character that belongs to a word; words in a window.
SPACE, INK, WINDOW = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", 8
SYMBOL, LETTER = r"[#*$%&|<>]", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
BULLET, ELLIPSIS = r"^[\x20\x09-\x0D]*([-*•‣▪]|o )", r"(\.\.\.|…)[\x20\x09-\x0D]*$"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that it for was with as on be at by this had not are but from or have an they which one you were "
    "der die und das ist nicht ein eine mit von auf für sich dem den des im zu als auch "
    "le la les et de des un une que est dans pour pas sur qui au avec ce il par "
    "el los las y en que del se por con una para es lo como no su al más pero"
).split()


class Rule(NamedTuple):
    """Bounds `at_least` <= 100 * measure / per <= `at_most` (None: no bound), for texts of at least `from_words` words."""

    name: str
    measure: str
    per: str
    at_least: int | None = None
    at_most: int | None = None
    from_words: int = 0


BASE = (
    Rule("few_words", "n_words", "one", at_least=2000),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=200, at_most=1500),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("words_without_letter", "n_letter_words", "n_words", at_least=60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=30),
    Rule("stop_words", "n_stop_words", "n_words", at_least=2, from_words=100),
)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for the row, however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), 0)


def _repeated(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that the text has twice or more."""

    def of(w: Column) -> Column:
        hashes = _bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size))))
        return _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(w, h)).otherwise(F.lit(0)))

    def covered(w: Column, h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        window = lambda x: F.slice(w, x["i"] + 1, size)
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (window(x) == window(y)), F.lit(False))
        marked = _bound(by_hash, lambda s: F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])))
        places = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
        fold = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + size - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + size).alias("end")))
        return fold["n"]

    return F.when(F.size(words) > size, _bound(words, of)).otherwise(F.lit(0))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Measures by name, of a text (not null), its words and its lines that hold a word."""
    count = lambda x: F.size(x).cast("bigint")
    return {
        "n_words": count(words),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("bigint"),
        "n_letter_words": count(F.filter(words, lambda w: w.rlike(LETTER))),
        "n_stop_words": count(F.filter(words, lambda w: w.isin([x for s in STOP_WORDS for x in (s, s.capitalize())]))),
        "n_lines": count(lines),
        "n_dup_lines": count(lines) - count(F.array_distinct(lines)),
        "n_bullet_lines": count(F.filter(lines, lambda x: x.rlike(BULLET))),
        "n_ellipsis_lines": count(F.filter(lines, lambda x: x.rlike(ELLIPSIS))),
        "n_repeat_words": _repeated(words).cast("bigint"),
    }


def failed(rule: Rule, measure: Callable[[str], Column]) -> Column:
    """Whether a rule is failed; never null."""
    a, b = (F.lit(1) if x == "one" else measure(x) for x in (rule.measure, rule.per))
    out = F.lit(False)
    if rule.at_least is not None:
        out |= 100 * a < rule.at_least * b
    if rule.at_most is not None:
        out |= 100 * a > rule.at_most * b
    return out & (measure("n_words") >= rule.from_words) if rule.from_words else out


def compiled(rules: Sequence[Rule], measure: Callable[[str], Column]) -> Column:
    """The names of the rules that a row fails, in the order of the table."""
    return F.filter(F.array(*[F.when(failed(r, measure), F.lit(r.name)) for r in rules]).cast("array<string>"), lambda x: x.isNotNull())


def rules_of(table: DataFrame, most: int = 1000) -> list[Rule]:
    """Rules from a table with the columns of Rule (name, measure, per, at_least, at_most, from_words); a table of thresholds has at most `most` rows."""
    rows = table.select("name", "measure", "per", "at_least", "at_most", "from_words").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(r[0], r[1], r[2], r[3], r[4], r[5] or 0) for r in rows]


def judged(docs: DataFrame, *, text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES, into: str = "quality") -> DataFrame:
    """The rows with a struct column `into`: every measure, `base_failed`, `failed` (names of all failed rules) and `kept`."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != into]
    one = docs.select(F.struct(*rest).alias(ROW), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    parts = one.select(ROW, "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(INK)).alias("l"))
    found = measures(F.col("t"), F.col("w"), F.col("l"))
    measured = parts.select(ROW, *[c.alias(n) for n, c in found.items()])
    verdict = measured.withColumns({"b": compiled(base, F.col), "m": compiled(rules, F.col)})
    fields = [*[F.col(n) for n in found], (F.size("b") > 0).alias("base_failed"), F.concat("b", "m").alias("failed"), (F.size("b") + F.size("m") == 0).alias("kept")]
    return verdict.select(f"{ROW}.*", F.struct(*fields).alias(into))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows that are kept, with their columns as they were."""
    return judged(docs, into="__quality", **how).where("__quality.kept").drop("__quality")


def op11(docs: DataFrame) -> DataFrame:
    q = judged(docs.select("doc_id", "text"), into="q")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_letter_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]
    return q.select("doc_id", *[f"q.{n}" for n in names], F.array_join("q.failed", ",").alias("rules_failed"))
