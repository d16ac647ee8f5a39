"""Model responses and labels as text: tags, numbers, labels, ids. Every function maps columns to a column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spellings, patterns, roles and templates that results depend on.
POSITIVE = ("match", "matched", "pos", "positive")
NEGATIVE = ("not_match", "not matched", "not_matched", "neg", "negative", "no_match")
NEGATIVE_WORDS = r"\b(?:not match|no match|non match|notmatching|unmatch|unmatched|mismatch|does not match|doesn't match|do not match|fails to match)\b"
POSITIVE_WORDS = r"\bmatch(?:es|ed|ing)?\b"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
ROLES = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "tool": "tool", "function": "tool", "observation": "tool"}
MATCHED_REASON = "The retrieved video contains the key query-required visual events and timing cues."
UNMATCHED_REASON = "The retrieved video does not satisfy the query-required visual evidence."

_SPACE = r"(?U)\s+"


def stripped(t: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def text_key(t: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return stripped(F.regexp_replace(F.lower(t), _SPACE, " "))


def filled(*columns: Column) -> Column:
    """The first column that isn't blank, stripped; empty if all are."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in columns], F.lit(""))


def first_tag(t: Column, tag: str) -> Column:
    """What the first <tag>...</tag> holds; empty if there is none."""
    return F.regexp_extract(t, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)


def last_tag(t: Column, tag: str) -> Column:
    """What the last <tag>...</tag> holds; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1)), F.lit(-1))


def answer_first(t: Column) -> Column:
    """matched, not_matched or unknown from the first answer tag."""
    a = F.regexp_replace(F.lower(first_tag(t, "answer")), " ", "_")
    return F.when(a.isin("matched", "match"), "matched").when(a.isin("not_matched", "not_match", "unmatched"), "not_matched").otherwise("unknown")


def answer_last(t: Column) -> Column:
    """The last answer tag in lower case with underscores, whatever it says; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(last_tag(t, "answer")), " ", "_"), F.lit(""))


def number(t: Column) -> Column:
    """The first number in a text."""
    return F.nullif(F.regexp_extract(t, NUMBER, 0), F.lit("")).try_cast("double")


def times_first(t: Column, duration: Column | None = None) -> Column:
    """struct(start, end) of the first time tags, cut to the duration, reversed ends swapped; null if a tag is missing."""
    s, e = number(first_tag(t, "start")), number(first_tag(t, "end"))
    both = s.isNotNull() & e.isNotNull()
    if duration is not None:
        most = F.greatest(duration, F.lit(0.0))
        s, e = (F.when(duration.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), most)) for x in (s, e))
    return F.when(both, F.struct(F.least(s, e).alias("start"), F.greatest(s, e).alias("end")))


def times_last(t: Column) -> Column:
    """struct(start, end) of the last time tags that hold nothing but a number; null if one is missing."""
    s, e = (F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?is)<{tag}>\s*({NUMBER})\s*</{tag}>"), F.lit(1)), F.lit(-1)).try_cast("double") for tag in ("start", "end"))
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("start"), e.alias("end")))


def has_tag(t: Column, tag: str) -> Column:
    return F.coalesce(t.rlike(rf"(?is)<{tag}>.*?</{tag}>"), F.lit(False))


def think_split(t: Column) -> Column:
    """struct(think, rest) around the first </think>; all is rest without one."""
    at = F.locate("</think>", t)
    return F.when(at > 0, F.struct(stripped(F.regexp_replace(F.substring(t, F.lit(1), at - 1), "(?i)<think>", "")).alias("think"), stripped(F.substring(t, at + 8, F.length(t))).alias("rest"))).otherwise(F.struct(F.lit("").alias("think"), stripped(t).alias("rest")))


def binary_label(t: Column) -> Column:
    """pos, neg or empty."""
    s = F.lower(stripped(F.coalesce(t, F.lit(""))))
    words = F.regexp_replace(s, r"(?U)[_\-\s]+", " ")
    return F.when(s.isin(*POSITIVE), "pos").when(s.isin(*NEGATIVE), "neg").when(words.rlike(NEGATIVE_WORDS), "neg").when(words.rlike(POSITIVE_WORDS), "pos").otherwise("")


def answer_label(t: Column) -> Column:
    b = binary_label(t)
    return F.when(b == "pos", "matched").when(b == "neg", "not_matched").otherwise("")


def tagged_line(t: Column, tag: str) -> Column:
    """What follows `tag:` on the first line that begins with it; empty if none does."""
    return F.regexp_extract(t, rf"(?im)^[\t ]*{tag}:[\t ]*(.*?)[\t ]*$", 1)


def number_range(t: Column) -> Column:
    """struct(start, end) of two numbers joined by a comma, dash or tilde; null unless both are there."""
    p = rf"({NUMBER})\s*[,~\-]\s*({NUMBER})"
    a, b = (F.nullif(F.regexp_extract(t, p, k), F.lit("")).try_cast("double") for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


def full_response(t: Column) -> Column:
    """struct(label, reasoning, start, end, parsed_ok) of a judge's answer: think part cut off, tagged lines read; a short answer without a label line is itself the label."""
    rest = think_split(t)["rest"]
    line = tagged_line(rest, "label")
    label = answer_label(F.when(line != "", line).when(F.length(rest) <= 32, rest).otherwise(""))
    times = number_range(tagged_line(rest, "temporal"))
    return F.struct(label.alias("label"), reasoning(tagged_line(rest, "reasoning")).alias("reasoning"), times["start"].alias("start"), times["end"].alias("end"), (label != "").alias("parsed_ok"))


def reasoning(t: Column) -> Column:
    """White space runs as one space, without a leading `reasoning:`."""
    s = F.regexp_replace(stripped(F.coalesce(t, F.lit(""))), r"(?is)^reasoning:\s*", "")
    return stripped(F.regexp_replace(s, _SPACE, " "))


def description_id(qid: Column) -> Column:
    """The number at the head of a query id such as 12_fig or 12_fig_7; null if there is none."""
    head = F.regexp_extract(F.regexp_replace(qid, "_fig.*$", ""), r"^(\d+)(?:_.*)?$", 1)
    return F.nullif(head, F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def with_extension(name: Column, ext: str = ".npy") -> Column:
    ext = ext if ext.startswith(".") else f".{ext}"
    return F.when(F.coalesce(stem(name), F.lit("")) == "", F.lit(f"unknown{ext}")).otherwise(F.concat(stem(name), F.lit(ext)))


def pair_id(pair: Column, qid: Column, index: Column, top1: Column) -> Column:
    """The pair's own id, else query::item, else the query's id (idx_N if that is blank)."""
    q = F.coalesce(F.nullif(filled(qid), F.lit("")), F.concat(F.lit("idx_"), index.cast("string")))
    return F.coalesce(F.nullif(filled(pair), F.lit("")), F.when(filled(top1) != "", F.concat(q, F.lit("::"), stem(filled(top1)))), q)


def gold_label(gold: Column, top1: Column, pos: Column, answer: Column) -> Column:
    """pos or neg: from the gold label, else from equal ids, else from the answer."""
    a, b = filled(top1), filled(pos)
    return F.coalesce(F.nullif(binary_label(gold), F.lit("")), F.when((a != "") & (b != ""), F.when(stem(a) == stem(b), "pos").otherwise("neg")), F.when(answer == "matched", "pos").otherwise("neg"))


def derived_answer(model: Column, gold: Column, top1: Column, pos: Column) -> Column:
    """matched or not_matched: from the model's label, else the gold label, else from equal ids; not_matched if nothing says."""
    a, b = filled(top1), filled(pos)
    return F.coalesce(F.nullif(answer_label(model), F.lit("")), F.nullif(answer_label(gold), F.lit("")), F.when((a != "") & (b != "") & (stem(a) == stem(b)), "matched"), F.lit("not_matched"))


def matched_span(model: tuple[Column, Column], gt: tuple[Column, Column], top1: tuple[Column, Column], duration: Column) -> Column:
    """struct(start, end): the first of the three spans that isn't reversed (a negative start counts as 0), else the whole duration, else 0 to 0."""

    def usable(s: Column, e: Column) -> Column:
        s0 = F.greatest(s, F.lit(0.0))
        return F.when(s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (e >= s0), F.struct(s0.alias("start"), e.alias("end")))

    whole = F.struct(F.lit(0.0).alias("start"), F.when(duration >= 0, duration).otherwise(0.0).alias("end"))
    return F.coalesce(usable(*model), usable(*gt), usable(*top1), whole)


def user_message(query: Column) -> Column:
    return F.concat(F.lit('Query: "'), query, F.lit('"\nRetrieved video: <video>'))


def assistant_message(answer: Column, model_reasoning: Column, model_think: Column, start_text: Column, end_text: Column) -> Column:
    why = F.coalesce(F.nullif(reasoning(model_reasoning), F.lit("")), F.nullif(reasoning(model_think), F.lit("")))
    yes = F.concat(F.lit("<think> "), F.coalesce(why, F.lit(MATCHED_REASON)), F.lit(" </think> <answer>matched</answer> <start>"), start_text, F.lit("</start> <end>"), end_text, F.lit("</end> <REFINE>"))
    no = F.concat(F.lit("<think> "), F.coalesce(why, F.lit(UNMATCHED_REASON)), F.lit(" </think> <answer>not_matched</answer> <REFINE>"))
    return F.when(answer == "matched", yes).otherwise(no)


def boxed(t: Column) -> Column:
    r"""What the last \boxed{...} holds, with one level of braces inside; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1)), F.lit(-1))


def options_text(options: Column) -> Column:
    """A. first, B. second, ... each on a line."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(65 + i), F.lit(". "), x)), "\n")


def quoted_query(t: Column) -> Column:
    """The query of a prompt: in quotes after `Query:`, else what follows on that line; empty if there is none."""
    quoted, line = F.regexp_extract(t, r'Query:\s*"(.*?)"', 1), F.regexp_extract(t, r"Query:[\t ]*(.*)", 1)
    return F.when(quoted != "", quoted).otherwise(stripped(line))


def search_text(t: Column) -> Column:
    """What the last search tag holds; after a last tag that isn't closed, all that follows; empty without one."""
    closed = last_tag(t, "search")
    at = F.length(t) - F.position(F.reverse(F.lit("<search>")), F.reverse(F.lower(t))) + 2
    open_ = F.when(F.lower(t).contains("<search>"), stripped(F.substring(t, at, F.length(t))))
    return F.coalesce(closed, open_, F.lit(""))


def instruction(t: Column) -> Column:
    """Stripped, with a full stop unless it ends in punctuation; empty stays empty."""
    s = stripped(t)
    return F.when(s == "", s).when(s.rlike(r"\p{P}$"), s).otherwise(F.concat(s, F.lit(".")))


def media_parts(t: Column) -> Column:
    """array of struct(kind, text): the text between <video> and <image> marks, and the marks, in order; empty text is left out."""
    marked = F.regexp_replace(t, "(<video>|<image>)", "\u0001$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda x: F.struct(F.when(x == "<video>", "video").when(x == "<image>", "image").otherwise("text").alias("kind"), x.alias("text")))
    return F.filter(parts, lambda p: (p["kind"] != "text") | (p["text"] != ""))


def role(t: Column) -> Column:
    """The role an alias stands for; user if it is unknown."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(ROLES.items())])
    return F.coalesce(F.try_element_at(known, F.lower(stripped(t))), F.lit("user"))


def bad_query(t: Column, min_chars: int = 3, min_alnum: int = 2) -> Column:
    """Whether a search query is blank, too short or has too few letters and digits."""
    s = stripped(F.coalesce(t, F.lit("")))
    return (F.length(s) < max(min_chars, 1)) | (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) < min_alnum)


def rank_step_bucket(d: Column) -> Column:
    """Size of a rank change as a bucket."""
    return F.when(d <= 2, d.cast("string")).when(d <= 5, "3-5").when(d <= 10, "6-10").when(d <= 20, "11-20").when(d <= 50, "21-50").when(d <= 100, "51-100").otherwise("101+")


def safe_number(t: Column, infinite: str = "keep") -> Column:
    """A number, null if it is none or NaN. infinite: `keep`, `null`, or `zero` (then whatever isn't finite is 0)."""
    x = t.try_cast("double")
    x = F.when(~F.isnan(x), x)
    if infinite == "keep":
        return x
    x = F.when(F.abs(x) != float("inf"), x)
    return F.coalesce(x, F.lit(0.0)) if infinite == "zero" else x


def whole_numbers(values: Column) -> Column:
    """Values rounded half to even, negatives as 0, what isn't a number left out; null if nothing stays."""
    n = F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = F.transform(n, lambda x: F.greatest(F.bround(x).cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(F.size(out) > 0, out)


def numbers_of(text: str, least: int = 1) -> list[int]:
    """Driver side: a comma-separated list such as 10,1,5 as sorted distinct numbers; anything below `least` is an error."""
    out = sorted({int(x) for x in text.split(",") if x.strip()})
    if not out or out[0] < least:
        raise ValueError(f"numbers of at least {least} are needed: {text!r}")
    return out
