"""Named dataset adapters: each maps its JSON rows to one shape (problem_id, problem, options, solution, media, problem_type, source).

An adapter is a table of where a field may come from; the first field that is filled wins. Unknown names that begin
with `Verified-Search` share one adapter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.parse import boxed, first_tag, options_text, role


@dataclass(frozen=True)
class Adapter:
    kind: str
    problem: tuple[str, ...] = ("problem", "question", "query")
    solution: tuple[str, ...] = ("solution", "answer")
    media: tuple[str, ...] = ("path", "video", "image")
    ids: tuple[str, ...] = ("problem_id", "id", "qid")
    media_type: str = "video"
    extra: dict[str, str] = field(default_factory=dict)


# The kinds of tasks that the named datasets hold.
ADAPTERS: dict[str, Adapter] = {
    "multiple-choice": Adapter("multiple choice"),
    "numerical": Adapter("numerical"),
    "regression": Adapter("regression"),
    "ocr": Adapter("OCR", media_type="image"),
    "free-form": Adapter("free-form"),
    "image-choice": Adapter("multiple choice", media_type="image"),
    "math": Adapter("math", media_type="image"),
    "spatial": Adapter("spatial"),
    "tracking": Adapter("tracking"),
    "segmentation": Adapter("segmentation"),
    "temporal-grounding": Adapter("temporal grounding", problem=("sentence", "query", "problem"), solution=("timestamp", "solution")),
    "temporal-spatial": Adapter("temporal-spatial grounding"),
    "caption": Adapter("caption", solution=("caption", "solution")),
    "search": Adapter("search", problem=("query", "problem"), solution=("gt_video", "solution")),
    "verified-search": Adapter("verified search", problem=("query", "problem"), solution=("gt_video", "solution"), media=("retrieved_video", "path")),
}


def adapter(name: str) -> Adapter:
    key = "verified-search" if name.lower().startswith("verified-search") else name.lower()
    if key not in ADAPTERS:
        raise ValueError(f"no adapter named {name!r}; there are {', '.join(ADAPTERS)}")
    return ADAPTERS[key]


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def adapted(df: DataFrame, name: str) -> DataFrame:
    """The rows of a named dataset in the common shape, with chat messages."""
    a = adapter(name)
    options = F.col("options").cast("array<string>") if "options" in df.columns else F.array().cast("array<string>")
    solution = _first(df, a.solution)
    answer = F.coalesce(F.nullif(first_tag(solution, "answer"), F.lit("")), boxed(solution), solution)
    question = F.when(F.size(options) > 0, F.concat(_first(df, a.problem), F.lit("\n"), options_text(options))).otherwise(_first(df, a.problem))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(f"<{a.media_type}>\n"), question).alias("content")))
    return df.select(_first(df, a.ids).alias("problem_id"), _first(df, a.problem).alias("problem"), options.alias("options"), answer.alias("solution"), _first(df, a.media).alias("media"), F.lit(a.kind).alias("problem_type"), F.lit(name).alias("source"), messages.alias("messages"))


def adapted_all(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [adapted(df, name) for name, df in parts.items()])


def share_gpt(df: DataFrame, rename: dict[str, str] | None = None, messages: str | None = None) -> DataFrame:
    """Chat rows with (from, value) or (role, content) messages as (role, content), roles by alias; columns renamed first. Rows without messages are left out."""
    out = df.withColumnsRenamed(rename or {})
    name = messages or next((c for c in ("messages", "conversations") if c in out.columns), None)
    if name is None:
        raise ValueError("no column messages or conversations")
    fields = out.schema[name].dataType.elementType.names
    who, what = ("role" if "role" in fields else "from"), ("content" if "content" in fields else "value")
    chat = F.transform(name, lambda m: F.struct(role(m[who]).alias("role"), m[what].alias("content")))
    return out.where(F.size(name) > 0).withColumn("messages", chat)
