"""Named datasets from small annotation files, with fields that are missing, null or empty."""

import pytest
from pyspark.sql import functions as F

from reelquery.sources import loaders


def one(spark, name, row, shape, **how):
    return loaders.load(spark.createDataFrame([row], shape), name, root="/data", **how).collect()


def test_every_name_has_a_loader(spark):
    names = "DAPO-Math VIRL ThinkLite-VL-Hard VideoR1 LongVideoReason TVBench STI-Bench MMR-VBench CG-Bench Charades-STA NeXT-GQA ActivityNet-TVG TimeR1 Verified-Match-Minimal Verified-Search".split()
    assert sorted(loaders.DATASETS) == sorted(names)
    with pytest.raises(ValueError, match="no dataset"):
        loaders.dataset("Verified-Searching")
    empty = spark.createDataFrame([], "other int")
    for name in [*names, "Verified-Search-charades"]:
        assert loaders.load(empty, name).columns[:3] == ["source", "question", "answer"]
        assert loaders.load(empty, name).count() == 0


def test_questions_and_answers(spark):
    (r,) = one(spark, "VIRL", ("<image> What?", "is \\boxed{Cartoonish}", ["a/../b.png"]), "question string, answer string, image array<string>")
    assert (r["question"], r["answer"], r["media"], r["media_kind"], r["problem_type"]) == ("What?", "Cartoonish", "/data/b.png", "image", "exact_match")
    assert [(m["role"], m["type"], m["value"]) for m in r["messages"]] == [("system", "text", ""), ("user", "image", "/data/b.png"), ("user", "text", "What?\nPut your final answer in \\boxed{}.")]
    assert one(spark, "VIRL", ("q", "\\boxed{x^2}", ["a"]), "question string, answer string, image array<string>")[0]["problem_type"] == "math"
    assert one(spark, "VIRL", ("q", "\\boxed{1}", ["a", "b"]), "question string, answer string, image array<string>") == []
    shape = "problem string, problem_type string, options array<string>, solution string, data_type string, path string"
    (r,) = one(spark, "VideoR1", ("Which?", "multiple choice", ["A. x", "B. y"], "\n<answer>A</answer>", "image", "./p"), shape)
    assert (r["question"], r["answer"], r["media"], r["media_kind"], r["problem_type"]) == ("Which?Options:\nA. x\nB. y\n", "A", "/data/p", "image", "exact_match")
    assert one(spark, "VideoR1", ("n", "numerical", None, "<answer>3</answer>", "video", "p"), shape)[0]["problem_type"] == "math"
    assert one(spark, "VideoR1", ("n", "OCR", None, "<answer>3</answer>", "video", "p"), shape) == one(spark, "VideoR1", ("n", "numerical", None, "3", "video", "p"), shape) == []
    shape = "question string, candidates array<string>, answer string, video string, start double, end double, file string"
    (r,) = one(spark, "TVBench", ("q", ["u", "v"], "v", "x.mp4", 1.0, 2.5, "/a/action_localization.json"), shape)
    assert (r["question"], r["answer"], r["span"], r["media"]) == ("Question: q\nOptions:\nA. u\nB. v\n", "B", [1.0, 2.5], "/data/action_localization/x.mp4")
    assert one(spark, "TVBench", ("q", ["u"], "u", "x.mp4", 1.0, 2.5, "/a/scene.json"), shape)[0]["span"] is None
    (r,) = one(spark, "MMR-VBench", ("q", ["(A) one", "", "(B) two"], "(B) two", "/v.mp4"), "question string, options array<string>, correctAnswer string, video string")
    assert (r["question"], r["answer"], r["media"]) == ("q\nOptions:\nA. one\nB. two", "B", "/v.mp4")
    (r,) = one(spark, "Charades-STA", ("a man", [1.0, 2.5], "v.mp4"), "description string, timestamps array<double>, video string")
    assert r["question"] == loaders.LOCATE + "a man" + loaders.LOCATE_FORMAT and r["span"] == [1.0, 2.5] and r["answer"] == "[1.0,2.5]" and r["problem_type"] == "iou"
    assert r["messages"][-1]["value"] == r["question"]


def test_searches_tell_missing_from_empty(spark):
    shape = "fig_desc string, query string, video string, gt_video string, qid bigint, hard_negative_ids array<string>, time array<string>, duration double"
    (r,) = one(spark, "Verified-Search-toy", (None, " q ", "v", "w", 7, [" a ", "", None], ["1", "2.5", "x"], 9.0), shape, system="find")
    assert (r["query"], r["gt_video"], r["qid"], r["hard_negative_ids"], r["span"], r["gt_duration"], r["bootstrap_video"], r["media"]) == ("q", "v", "7", ["a"], [1.0, 2.5], 9.0, "", None)
    assert r["messages"][0]["value"] == "find" and len(r["messages"]) == 2
    assert one(spark, "Verified-Search", ("", "q", "v", "w", 7, None, None, None), shape) == []  # an empty description is there; it isn't replaced
    (r,) = one(spark, "Verified-Search", ("d", "q", "v", "w", None, None, ["x", "1"], None), shape, query_key="query", gt_key="gt_video")
    assert (r["query"], r["gt_video"], r["qid"], r["hard_negative_ids"], r["span"]) == ("q", "w", "", [], None)


def test_media_that_is_not_there(spark):
    rows = spark.createDataFrame([("a", "1", "x.mp4"), ("b", "2", "y.mp4"), ("", "3", "x.mp4")], "problem string, solution string, path string")
    present = spark.createDataFrame([("/data/x.mp4",), ("/data/x.mp4",)], "path string")
    got = loaders.load(rows, "Verified-Match-Minimal", root="/data/", present=present).collect()
    assert [(r["question"], r["media"], r["media_kind"]) for r in got] == [("a", "/data/x.mp4", "video")]
    math = spark.createDataFrame([("q", "1")], "prompt string, solution string")
    assert loaders.load(math, "DAPO-Math", present=present).count() == 1
    both = loaders.load_all({"DAPO-Math": math, "Verified-Match-Minimal": rows}, root="/data")
    assert sorted(r["source"] for r in both.collect()) == ["DAPO-Math", "Verified-Match-Minimal", "Verified-Match-Minimal"]


@pytest.mark.parametrize("path, want", [("/a//b/./c", "/a/b/c"), ("a/../b", "b"), ("../b", "../b"), ("/../b", "/b"), ("a/b/../../c", "c"), ("", ""), ("../../x/..", "../..")])
def test_normal_paths(spark, path, want):
    assert spark.range(1).select(loaders.normal_path(F.lit(path))).first()[0] == want
