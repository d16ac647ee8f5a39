"""Annotation files of named datasets as training rows, under the names that a configuration uses.

A dataset is a rule for each part of a row: question, answer, media, type of problem. Rules are column expressions over what the
file has; a field that the file lacks is null, which is not the same as an empty one. `load` brings every dataset into one
shape, so that several can be united:

source, question, answer, span (start and end in seconds, where the answer or the segment is one), media, media_kind,
problem_type, messages (role, type, value: system prompt, media, question), and for searches query, gt_video, qid,
bootstrap_video, hard_negative_ids, gt_duration.

Rows that a dataset's rule leaves out (several images, no answer, another kind of problem) are gone. With `present` (column
path), rows whose media isn't there are gone too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.parse import boxed, first_tag, stem, stripped

# The texts around a question on which results depend.
LOCATE = "Locate the start and end timestamps of the video segment corresponding to the description: "
LOCATE_FORMAT = " Please provide the start and end timestamps (in seconds, precise to one decimal places) in the format \\boxed{[start, end]}."
GROUNDED_FORMAT = (
    "Please answer the question, and then provide the video segment that best supports your answer. "
    "The start and end timestamps must be in seconds with exactly one decimal place.\n"
    "Output format: \\boxed{answer <> [start, end]}. For example: \\boxed{A <> [20.3, 30.8]}."
)
BOXED = "\nPut your final answer in \\boxed{}."
#: Tasks whose questions are about a segment of the video.
SEGMENT_TASKS = ("action_sequence", "action_localization")


class Fields:
    """The columns of a file; null where it has none of that name."""

    def __init__(self, df: DataFrame):
        self.kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def __call__(self, name: str, kind: str = "string") -> Column:
        return F.col(f"`{name}`").cast(kind) if name in self.kinds else F.lit(None).cast(kind)

    def first(self, *names: str) -> Column:
        """The first of the columns that the file has and that isn't null, stripped; empty if there is none."""
        return stripped(F.coalesce(*[self(n) for n in names], F.lit("")))


@dataclass(frozen=True)
class Dataset:
    """Rules of a named dataset; each takes the fields. media below the data folder; no rule: no media."""

    question: Callable[[Fields], Column]
    answer: Callable[[Fields], Column]
    problem_type: Callable[[Fields], Column]
    media: Callable[[Fields], Column] | None = None
    media_kind: Callable[[Fields], Column] = lambda f: F.lit("video")
    kept: Callable[[Fields], Column] = lambda f: F.lit(True)
    span: Callable[[Fields], Column] = lambda f: F.lit(None).cast("array<double>")
    grounding: bool = False
    search: bool = False


def _is(kind: str) -> Callable[[Fields], Column]:
    return lambda f: F.lit(kind)


def _of(name: str) -> Callable[[Fields], Column]:
    return lambda f: f(name)


def _without_mark(name: str) -> Callable[[Fields], Column]:
    return lambda f: stripped(F.replace(f(name), F.lit("<image>"), F.lit("")))


def _lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _lettered(name: str) -> Callable[[Fields], Column]:
    return lambda f: F.transform(f(name, "array<string>"), lambda x, i: F.concat(F.chr(65 + i), F.lit(". "), x))


def _tag(t: Column) -> Column:
    """What the answer tag holds; null without one."""
    return F.when(t.rlike("(?is)<answer>.*?</answer>"), first_tag(t, "answer"))


def _located(text: str, time: str) -> Dataset:
    return Dataset(lambda f: F.concat(F.lit(LOCATE), f(text), F.lit(LOCATE_FORMAT)), lambda f: F.to_json(f(time, "array<double>")), _is("iou"), _of("video"), span=lambda f: f(time, "array<double>"), grounding=True)


def _mathematical(answer: Column) -> Column:
    """Whether an answer can be checked as mathematics: it has a digit, a TeX command or an operator between terms."""
    return answer.rlike(r"\d|\\[a-zA-Z]+|\S\s*[=^+*/]\s*\S")


def _tv_answer(f: Fields) -> Column:
    at = F.array_position(f("candidates", "array<string>"), f("answer"))
    return F.when(at > 0, F.chr(64 + at.cast("int")))


_MATCH = Dataset(
    lambda f: f.first("problem", "query"),
    lambda f: f.first("solution"),
    _is("exact_match"),
    lambda f: f.first("path"),
    media_kind=lambda f: F.lower(stripped(F.coalesce(f("data_type"), F.lit("video")))),
    kept=lambda f: (f.first("problem", "query") != "") & (f.first("solution") != "") & (f.first("path") != ""),
    grounding=True,
)


def searched(query_key: str = "fig_desc", gt_key: str = "video") -> Dataset:
    """The search dataset, whose configuration names the columns of query and target."""
    return Dataset(
        lambda f: f.first(query_key, "query"),
        lambda f: f.first(gt_key, "gt_video", "video"),
        _is("retrieval"),
        kept=lambda f: (f.first(query_key, "query") != "") & (f.first(gt_key, "gt_video", "video") != ""),
        span=lambda f: _pair(F.coalesce(f("gt_time", "array<string>"), f("time", "array<string>"))),
        grounding=True,
        search=True,
    )


def _pair(times: Column) -> Column:
    """The first two values as numbers; null unless both are."""
    a, b = (F.get(times, i).try_cast("double") for i in (0, 1))
    return F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))


DATASETS: dict[str, Dataset] = {
    "DAPO-Math": Dataset(_of("prompt"), _of("solution"), _is("math")),
    "VIRL": Dataset(
        _without_mark("question"),
        lambda f: boxed(f("answer")),
        lambda f: F.when(_mathematical(boxed(f("answer"))), "math").otherwise("exact_match"),
        lambda f: F.get(f("image", "array<string>"), 0),
        media_kind=_is("image"),
        kept=lambda f: F.size(f("image", "array<string>")) == 1,
    ),
    "ThinkLite-VL-Hard": Dataset(_without_mark("problem"), _of("ground_truth"), _of("problem_type"), _of("image"), media_kind=_is("image")),
    "VideoR1": Dataset(
        lambda f: F.when(f("problem_type") == "multiple choice", F.concat(f("problem"), F.lit("Options:\n"), F.array_join(F.transform(f("options", "array<string>"), lambda x: F.concat(x, F.lit("\n"))), ""))).otherwise(f("problem")),
        lambda f: _tag(f("solution")),
        lambda f: F.when(f("problem_type") == "multiple choice", "exact_match").otherwise("math"),
        _of("path"),
        media_kind=_of("data_type"),
        kept=lambda f: f("problem_type").isin("multiple choice", "numerical") & _tag(f("solution")).isNotNull(),
    ),
    "LongVideoReason": Dataset(_of("problem"), lambda f: _tag(f("answer")), _is("exact_match"), _of("videos"), kept=lambda f: f("data_type") == "video"),
    "TVBench": Dataset(
        lambda f: F.concat(F.lit("Question: "), f("question"), F.lit("\nOptions:\n"), F.array_join(F.transform(_lettered("candidates")(f), lambda x: F.concat(x, F.lit("\n"))), "")),
        _tv_answer,
        _is("exact_match"),
        lambda f: F.concat_ws("/", stem(f("file")), f("video")),
        span=lambda f: F.when(stem(f("file")).isin(*SEGMENT_TASKS), F.array(f("start", "double"), f("end", "double"))),
    ),
    "STI-Bench": Dataset(
        lambda f: F.concat(F.lit("From "), f("time_start"), F.lit(" s to "), f("time_end"), F.lit(" s. "), f("Question"), F.lit("\n"), _lines(F.transform(F.map_entries(f("Candidates", "map<string,string>")), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])))),
        _of("Answer"),
        _is("exact_match"),
        _of("Video"),
    ),
    "MMR-VBench": Dataset(
        lambda f: F.concat(f("question"), F.lit("\nOptions:\n"), _lines(F.transform(F.filter(f("options", "array<string>"), lambda x: x != ""), lambda x: F.concat(F.substring(x, 2, 1), F.lit("."), F.substring(x, F.lit(4), F.length(x)))))),
        lambda f: F.substring(f("correctAnswer"), 2, 1),
        _is("exact_match"),
        _of("video"),
    ),
    "CG-Bench": Dataset(lambda f: F.concat(f("question"), F.lit("\nOptions:\n"), _lines(_lettered("choices")(f))), _of("right_answer"), _is("exact_match"), lambda f: F.concat(F.lit("filtered_videos/"), f("video_uid"), F.lit(".mp4"))),
    "Charades-STA": _located("description", "timestamps"),
    "NeXT-GQA": Dataset(
        lambda f: F.concat(F.lit("Question: "), f("question"), F.lit("\nOptions:\n"), _lines(f("options", "array<string>")), F.lit("\n" + GROUNDED_FORMAT)),
        lambda f: f("answer"),
        _is("gqa"),
        _of("video"),
        span=lambda f: f("timestamps", "array<double>"),
        grounding=True,
    ),
    "ActivityNet-TVG": _located("description", "timestamps"),
    "TimeR1": _located("sentence", "timestamp"),
    "Verified-Match-Minimal": _MATCH,
    "Verified-Search": searched(),
}


def dataset(name: str, **keys: str) -> Dataset:
    """The rules of a name; every name that begins with `Verified-Search-` is a search."""
    if name == "Verified-Search" or name.startswith("Verified-Search-"):
        return searched(**keys)
    if name not in DATASETS:
        raise ValueError(f"no dataset named {name!r}; there are {', '.join(DATASETS)}")
    return DATASETS[name]


def normal_path(p: Column) -> Column:
    """A path without empty and `.` parts, and with `..` taken up."""
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    up = F.lit("..")
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == up) & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != up), F.slice(a, 1, F.size(a) - 1)).when((x == up) & p.startswith("/"), a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(fold, "/"))


def load(df: DataFrame, name: str, root: str = "", system: str = "", present: DataFrame | None = None, **keys: str) -> DataFrame:
    """The rows of a named dataset in the common shape. df: its annotation rows as they were read (for TVBench with their `file`); root: the folder of its media; system: the system prompt."""
    d, f = dataset(name, **keys), Fields(df)
    none = F.lit(None).cast("string")
    media = none
    if d.media is not None:
        own = d.media(f)
        media = normal_path(F.when(own.startswith("/") | F.lit(root == ""), own).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), own)))
    rows = df.where(F.coalesce(d.kept(f), F.lit(False))).select(
        F.lit(name).alias("source"),
        d.question(f).alias("question"),
        d.answer(f).alias("answer"),
        d.span(f).alias("span"),
        media.alias("media"),
        (d.media_kind(f) if d.media is not None else none).alias("media_kind"),
        d.problem_type(f).alias("problem_type"),
        *_search_columns(d, f, keys),
    )
    said = F.col("question") if d.grounding else F.concat("question", F.lit(BOXED))
    part = lambda role, kind, value: F.struct(F.lit(role).alias("role"), kind.alias("type"), value.alias("value"))
    shown = F.filter(F.array(part("user", F.col("media_kind"), F.col("media"))), lambda m: m["value"].isNotNull())
    rows = rows.withColumn("messages", F.concat(F.array(part("system", F.lit("text"), F.lit(system))), shown, F.array(part("user", F.lit("text"), said))))
    if present is None:
        return rows
    there = present.select(F.col("path").alias("media")).distinct()
    return rows.where("media is null").unionByName(rows.where("media is not null").join(there, "media", "left_semi").select(*rows.columns))


def _search_columns(d: Dataset, f: Fields, keys: dict[str, str]) -> list[Column]:
    none = lambda kind: F.lit(None).cast(kind)
    if not d.search:
        return [none(k).alias(n) for n, k in (("query", "string"), ("gt_video", "string"), ("qid", "string"), ("bootstrap_video", "string"), ("hard_negative_ids", "array<string>"), ("gt_duration", "double"))]
    hard = F.filter(F.transform(f("hard_negative_ids", "array<string>"), stripped), lambda x: x != "")
    return [d.question(f).alias("query"), d.answer(f).alias("gt_video"), f.first("qid").alias("qid"), f.first("bootstrap_video", "retrieved_video", "negative_video").alias("bootstrap_video"), F.coalesce(hard, F.array().cast("array<string>")).alias("hard_negative_ids"), f("duration", "double").alias("gt_duration")]


def load_all(parts: dict[str, DataFrame], **how) -> DataFrame:
    """Several datasets by name, one below the other."""
    return reduce(DataFrame.unionByName, [load(df, name, **how) for name, df in parts.items()])
