"""Operators of reelquery.llm against brute force, exact round trips and held-out accuracy, and on awkward tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelquery.llm import bits, bpe, common, components, decontam, langid, licenses, minhash, pii, pieces, queries, sentences, tokenfile, toxicity, vectors
from reelquery.llm.common import ROW

SF = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, spans string, items int, row int, id int, n int, score double, base int, clean string, comp int, __id string, __rn int"


def weird(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, columns that clash."""
    extra = (1, "s", 2, 3, 4, 5, 0.5, 6, "c", 7, "x", 8)
    long = " ".join(f"word{i % 977} mail{i}@ex{i % 7}.com." for i in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away. It was late. Nobody saw it.", "en", "a", 80),
        (2, "the quick brown fox jumps over the lazy dog and runs away. It was late. nobody saw it.", "en", "a", 80),
        (2, "the quick brown fox jumps over the lazy dog and runs away. It was late. nobody saw it.", "en", "a", 80),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, "a", "en", None, 1),
        (7, long, "en", "a", len(long)),
        (8, "é" * 30000, "fr", "b", 30000),
        (9, "x" * 50000, None, "b", 50000),
        (None, "no id here at all, mail me: me@here.org", "en", "b", 3),
        (10, "Don't <|endoftext|>  stoṕ 中文 123-456 it's\r\n\r\nA  B", "en", "b", 3),
        (11, "+1 (555) 010-9999 and 4111 1111 1111 1111 at 10.0.0.256 or 10.0.0.25.7", "en", "b", 3),
    ]
    return spark.createDataFrame([r + extra for r in rows], CLASH)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "clicks", "clients"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


def nothing(spark):
    return spark.createDataFrame([], CLASH)


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away it"), (2, "nobody saw"), (None, "was late"), (4, None), (5, "..."), (1, "zzz yyy")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (7, None), (8, 0), (8, 1), (None, 1), (99, 0)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by 1").fetchall()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# 1 ---------------------------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def agrees(got, text):
    spans = base(text)
    said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    assert [got[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in spans) for k in KINDS]
    assert got["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert {f"{kind}:{a}:{b}" for a, _, b, kind in spans} <= set(got["spans"].split(","))


def test_pii_base_spans(spark, docs):
    got = rows_of(queries.op1_pii(spark, SF))
    assert len(got) == len(docs)
    for i, text, _ in docs:
        agrees(got[i], text)


def test_pii_awkward(spark):
    w = weird(spark)
    got = pii.op1(spark, w).collect()
    assert len(got) == w.count()
    texts = {r.doc_id: r.text for r in w.collect()}
    for r in got:
        agrees(r, texts[r.doc_id])
    assert pii.op1(spark, nothing(spark)).count() == 0
    tricky = ["a@b.cde_x@y.z", "x@y.z@w.v.u", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111 4111  1111", "+12 34 56 78 90+123456789.", "a@b.c.@d.e", "0001.02.3.4", "é@x.y 😀 a@b.co"]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id bigint, text string")
    for r in pii.op1(spark, df).collect():
        agrees(r, tricky[r.doc_id])


def test_pii_terms_that_disclose(spark):
    names = ["Karl", "Rosa", "Imre"]
    rows = [(i, f"note {i}: {names[i % 3]} wrote from {names[i % 3].lower()}@mail.org today, number {i} of the list") for i in range(30)]
    rows += [(100 + i, f"today nobody wrote number {i} of the list from here") for i in range(300)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = rows_of(pii.sanitize(df))
    assert all(n not in r["text"] and "[EMAIL]" in r["text"] for i, r in got.items() if i < 100 for n in names)
    assert all(got[i]["text"] == t for i, t in rows if i >= 100)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert "today" in got[0]["text"]


@pytest.mark.parametrize("copies", [1, 40])
def test_pii_copies_count_once(spark, copies):
    texts = [f"note {i}: Karl{' from Berlin' * (i == 1)} wrote as k@mail.org on day {i}" for i in range(3)]
    rows = [(1000 * i + j, t) for i, t in enumerate(texts) for j in range(copies)]
    rows += [(10_000 + i, f"nobody wrote as number {i} on day {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(pii.sanitize(df))
    assert all("Karl" not in got[i]["text"] and "wrote" in got[i]["text"] for i, _ in rows if i < 10_000)
    assert "Berlin" in got[1000]["text"]  # in one text only: no support
    scores = {r["term"]: r["disclosure"] for r in pii.disclosures(df.select("text", F.xxhash64("text").alias("doc"), pii.base_spans(F.col("text")).alias("base"))).collect()}
    assert scores["karl"] == pytest.approx(1) and "wrote" not in scores


def test_pii_terms_far_from_their_entity(spark):
    far = " ".join(f"word{j % 9}" for j in range(60))
    rows = [(i, f"Rosalind heads section {i}. {far} mail {i} to r@mail.org at {i} or so. {far} yours, ROSALIND") for i in range(4)]
    rows += [(100 + i, f"section {i} has {far} mail at {i} or so, yours") for i in range(200)]
    got = rows_of(pii.sanitize(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert all("rosalind" not in got[i]["text"].lower() and "yours" in got[i]["text"] for i in range(4))
    assert all(got[i]["text"] == t for i, t in rows if i >= 100)


def test_pii_many_matches(spark):
    """Linear in the matches of a text: seconds for hundreds of thousands of numbers, and the same spans in parts."""
    rows = [(0, ", ".join(str(10 + i % 90) for i in range(400_000))), (1, " ".join(f"u{i}@h{i % 9}.org, +49 30 {1000000 + i}; 10.0.{i % 300}.7" for i in range(700))), (2, "4111 1111 1111 1111, " * 300 + "1 2 3 4 5 6 7 8 9 0 1")]
    for r in pii.op1(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        agrees(r, rows[r.doc_id][1])
    clean = rows_of(pii.sanitize(spark.createDataFrame(rows[1:], "doc_id bigint, text string")))
    assert clean[1]["text"].startswith("[EMAIL], [PHONE]; [IP] [EMAIL]") and clean[2]["text"] == "[CARD], " * 300 + "1 2 3 4 5 6 7 8 9 0 1"


def test_pii_megabyte_of_addresses(spark):
    """Linear in the spans of a text: a megabyte of e-mails takes little longer than a few, and is rewritten exactly."""
    text = " ".join(f"word{i % 977} user{i}@ex{i % 7}.com. \U0001f600" for i in range(40_000))
    df = lambda x: spark.createDataFrame([(1, x)], "doc_id bigint, text string")
    start = time.monotonic()
    short = rows_of(pii.sanitize(df(text[:200])))[1]["text"]
    few = time.monotonic() - start
    assert short == re.sub(KINDS["email"], "[EMAIL]", text[:200])
    assert rows_of(pii.sanitize(df(text)))[1]["text"] == re.sub(KINDS["email"], "[EMAIL]", text)
    assert time.monotonic() - start - few < few + 20


def test_pii_parts_of_a_text(spark):
    """Pieces between any two places are those of the whole text, at the edges of parts too."""
    text = "".join(chr(0x1F600 + i % 50) if i % 3 else "\n" if i % 2 else "ab"[i % 2] for i in range(3 * pii.CHUNK + 5))
    edges = [0, 1, *(k * pii.CHUNK + d for k in (1, 2, 3) for d in (-1, 0, 1)), len(text), len(text) + 9]
    rows = [(a, b, text) for a in edges for b in edges] + [(0, 5, ""), (0, 0, "")]
    df = spark.createDataFrame(rows, "a int, b int, text string")
    got = df.select("a", "b", "text", pii._let(pii._parts(F.col("text")), lambda p: pii._between(p, F.col("a"), F.col("b"))).alias("got")).collect()
    assert len(got) == len(rows) and all(r.got == r.text[r.a : r.b] for r in got)


def test_pii_text_of_many_disclosing_terms(spark):
    """Terms are found in slots where a text has many of them, as they are one by one."""
    names = [f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, f"{i} {' '.join(names)} k@mail.org {i} {' '.join(reversed(names))}") for i in range(3)] + [(100 + i, f"nobody wrote on day {i}") for i in range(300)]
    got = rows_of(pii.op1(spark, spark.createDataFrame(rows, "doc_id bigint, text string")))
    for i, t in rows[:3]:
        spans = [x.split(":") for x in got[i]["spans"].split(",")]
        terms = [t[int(s) : int(e)] for k, s, e in spans if k in ("term", "gone")]
        assert terms == names + names[::-1]
    assert all(got[i]["spans"] == "" for i, _ in rows[3:])


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_hits(doc, item_rows, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, x in item_rows:
        w = pattern.findall(lower(x))
        for k in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    w = pattern.findall(lower(doc))
    hit, found = [False] * len(w), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in windows:
                hit[k : k + n] = [True] * n
                found |= windows[x]
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


def test_decontaminate(spark, docs):
    item_rows = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = rows_of(queries.op2_decontaminate(spark, SF))
    assert all(tuple(got[i])[1:] == brute_hits(t, item_rows) for i, t, _ in docs)


@pytest.mark.parametrize(("block", "chained"), [(100_000, 6), (12, 6), (12, 1)])
def test_decontaminate_awkward(spark, monkeypatch, block, chained):
    monkeypatch.setattr(decontam, "CHAINED", chained)
    w, it = weird(spark), items(spark)
    item_rows = [tuple(r) for r in it.collect()]
    found = decontam.scan(w, it, keep=["doc_id", "text"], clean=True, block_words=block).collect()
    assert len(found) == w.count()
    for r in found:
        want = brute_hits(r[ROW]["text"], item_rows)
        assert (r["n_words"], r["n_hit"], len(r["items"])) == want[:3]
    assert decontam.op2(spark, nothing(spark), it).count() == 0
    assert not any(r["contaminated"] for r in decontam.op2(spark, w, it.limit(0)).collect())
    cleaned = rows_of(decontam.decontaminate(w, it, max_coverage=1.0))
    assert "fox" not in cleaned[1]["text"] and cleaned[3]["text"] is None and cleaned[9]["text"] == "x" * 50000


def test_automaton_random():
    rng = random.Random(4)
    for _ in range(60):
        its = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(1, 6))]
        auto = decontam.Automaton(4)
        for i, t in its:
            if t:
                auto.add(str(i), t.encode().split())
        auto.finish()
        for _ in range(10):
            d = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))
            spans, found = auto.walk(d.encode().split()) if len(d.split()) >= auto.least else ([], set())
            want = brute_hits(d, its, 4)
            assert (sum(b - a for a, b in spans), len(found)) == want[1:3]


# 3 ---------------------------------------------------------------------------------------------------------------


def test_language(spark, docs):
    got = rows_of(queries.op3_language(spark, SF))
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["lang_pred"] == lang for i, _, lang in docs if i in set(held))
    assert right / len(held) > 0.9


def test_language_awkward(spark):
    got = langid.op3(spark, weird(spark)).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5))
    assert langid.op3(spark, nothing(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert langid.op3(spark, unlabelled).first()["lang_pred"] == "und"


def brute_language(model, text):
    """Language, score and whether the margin is narrow, from the compressed sizes under every dictionary."""
    import zstandard

    words = "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    data = " ".join(words).encode()
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0, True
    sizes = {}
    for name, dictionary in model:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        for a in range(0, len(data), langid.BLOCK):
            one = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = sizes.get(name, 0) + len(one.compress(data[a : a + langid.BLOCK]))
    least, second = sorted(sizes.values())[:2]
    margin = (second - least) / second
    return min(n for n, x in sizes.items() if x == least), 1 - math.exp(-40 * margin), margin < langid.NARROW


def test_language_is_the_smallest_size(spark, docs):
    """Every document against the sizes under all dictionaries; equal dictionaries tie: the first name, rejected."""
    rows = [(i, t) for i, t, _ in docs] + [(-1, None), (-2, ""), (-3, "123 ?!"), (-4, "straße " * 3000), (-5, "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(model) > 1 and all(8 <= len(d) <= langid.DICT_BYTES for _, d in model)
    for own in (model, [("b", model[0][1]), ("a", model[0][1]), ("c", model[1][1])]):
        own = sorted(own)
        for r in langid.predict(frame, own, keep=["doc_id"]).collect():
            name, score, narrow = brute_language(own, dict(rows)[r[ROW].doc_id])
            assert (r.lang_pred, r.rejected) == (name, narrow) and r.score == pytest.approx(score)
            assert own is model or r.lang_pred != "b"


# 4 ---------------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs):
    t = pieces.tokenizer(pieces.default_path("byte_bpe_50k.json"))
    got = rows_of(queries.op4_token_files(spark, SF))
    start = 0
    for i, text, _ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_awkward(spark, tmp_path):
    w = weird(spark)
    tokenfile.write_tokens(w, str(tmp_path / "t"), block=5000)
    got = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert len(got) == 13 and keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    t = pieces.tokenizer(pieces.default_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in w.collect()}
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
    assert tokenfile.read_document(spark, str(tmp_path / "t"), 3) == [[2]]
    assert len(tokenfile.read_document(spark, str(tmp_path / "t"), 2)) == 2
    tokenfile.write_tokens(nothing(spark), str(tmp_path / "none"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("base", [300, 50_257, 70_000])
def test_repair_random(base):
    rng = np.random.default_rng(base)
    for n in (1, 5, 3000):
        ids = rng.choice([3, 3, 3, 4, 5, base - 1], n).astype(np.int32)
        ends = np.unique(np.concatenate((rng.integers(1, n + 1, 4), [n])))
        rules, symbols, per = tokenfile.compress(ids, ends, base)
        lengths = tokenfile.lengths_of(rules, base)
        b = tokenfile.Block(base, 4, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes())
        first, at = 0, 0
        for k, end in zip(per.tolist(), ends.tolist(), strict=True):
            assert b.expand(first, k).tolist() == ids[at:end].tolist()
            assert [b.token(first, k, j) for j in range(end - at)] == ids[at:end].tolist()
            first, at = first + k, end
        assert n < 100 or len(symbols) < n / 2


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.setdefault(i, set()).update([frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))] if w else [])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    every = [(i, s) for i, own in sets.items() for s in own]
    for x, (i, a) in enumerate(every):
        for j, b in every[:x]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}


def test_minhash(spark, docs):
    want = brute_components([(i, t) for i, t, _ in docs], 4, 80)
    got = rows_of(queries.op5_minhash(spark, SF))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_hub_of_near_copies(spark):
    """Near copies of one text that are often unlike each other, with outliers that link only to some."""
    rng = random.Random(7)
    hub = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(hub))]
    for i in range(220):
        w = list(hub)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99999)}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"y{i}-{j}" for j in range(60))) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()
    want = brute_components(rows, 4, 80)
    assert {r["id"]: r["component"] for r in got} == want


def test_minhash_awkward(spark):
    w = weird(spark)
    got = minhash.op5(spark, w).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["n_shingles"] > 5
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5))
    assert by[6]["n_shingles"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.op5(spark, nothing(spark)).count() == 0
    kept = minhash.deduplicate(w, words=5)
    assert kept.columns == w.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and kept.where("doc_id is null").count() == 1
    assert minhash.deduplicate(nothing(spark)).count() == 0


def test_vectors_of_any_size_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [-1e200, 0.0])]
    got = rows_of(vectors.op10(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")), "vec_id")
    assert [got[i]["n_links"] for i in range(1, 8)] == [3, 3, 3, 3, 1, 1, 0]
    assert [got[i]["component_id"] for i in range(1, 8)] == [1, 1, 1, 1, 5, 5, 7]


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["comp"] for r in got.collect()} == {i: top(i) for i in list(up)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def test_sentence_spans(spark):
    p = "Alpha beta gamma delta epsilon and so on. Zeta eta theta iota kappa and all that! Lambda mu nu xi omicron, as ever? Pi rho sigma tau one two three."
    own = lambda i: f"Only{i} here{i} stands{i} this{i}. And{i} that{i} too{i}."
    rows = [(1, f"{own(1)} {p} {own(11)}"), (2, f"{own(2)}\n{p.upper()}\n{own(22)}"), (3, own(3)), (4, f"{p} {own(4)} {p}"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(sentences.op6(spark, df))
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"].split() == f"{own(2)} {own(22)}".split() and got[2]["has_repeat"]
    assert got[3]["text"] == own(3)
    assert got[4]["text"].split() == own(4).split()
    assert got[5]["text"] is None and got[6]["text"] == ""


def brute_runs(rows, span=2, least=28):
    """Sentences and removed sentences of each document: runs of `span` sentences that grow to `least` words, and one to the end."""
    first, split, out = {}, {}, {}
    for i, t in sorted(rows):
        own = []
        for s in re.findall(r"[^\r\n]+?(?:(?<=[.!?])[ \t]+|$|(?=[\r\n]))", t or ""):
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(s))
            if w:
                own.append(tuple(w))
        found = []
        for a in range(len(own)):
            b = a + min(span, len(own))
            while b < len(own) and sum(map(len, own[a:b])) < least:
                b += 1
            if b <= len(own) and sum(map(len, own[a:b])) >= least:
                found.append((tuple(own[a:b]), a, b))
        start = found[-1][1] if found else 0
        if own and (not found or found[-1][2] < len(own)):
            found.append((tuple(own[start:]), start, len(own)))
        split[i] = own, found
        for r, _, _ in found:
            first.setdefault(r, i)
    for i, (own, found) in split.items():
        gone, mine = set(), set()
        for r, a, b in found:
            if first[r] != i or r in mine:
                gone |= set(range(a, b))
            mine.add(r)
        out[i] = len(own), len(gone)
    return out


def test_sentence_spans_of_documents(spark, docs):
    want = brute_runs([(i, t) for i, t, _ in docs])
    got = rows_of(queries.op6_sentence_spans(spark, SF))
    assert {i: (r["n_sentences"], r["n_removed"]) for i, r in got.items()} == want
    for i, t, _ in docs:
        gone = [tuple(map(int, x.split(":"))) for x in got[i]["removed"].split(",") if x]
        left = "".join(t[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(t)], strict=True)) if t else t
        assert got[i]["text"] == (left.encode().rstrip().decode() if gone else t)


def test_sentence_runs_grow(spark):
    short = " ".join(f"{w}!" for w in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split() * 2 + ["fifteen"])
    long = " ".join(f"l{i}" for i in range(30)) + ". " + " ".join(f"m{i}" for i in range(30)) + "."
    line = "A line that many share, with twenty words or so, but without anything that is worth to be removed at all."
    rows = [(1, short), (2, short), (3, f"Alone in three.\n{long}\nOwn end three."), (4, f"Alone in four.\n{long}\nOwn end four."), (5, f"{line}\nShort."), (6, f"{line}\nShort.")]
    got = rows_of(sentences.op6(spark, spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[1]["text"] == short and got[2]["text"] == "" and got[2]["n_removed"] == 29
    assert got[3]["text"] == rows[2][1] and got[4]["text"].split() == "Alone in four. Own end four.".split()
    assert got[5]["text"] == rows[4][1] and got[6]["text"] == ""  # fewer than 28 words in all, but the same document
    assert {i: (r["n_sentences"], r["n_removed"]) for i, r in got.items()} == brute_runs(rows)


def test_sentence_spans_awkward(spark):
    got = sentences.op6(spark, weird(spark)).collect()
    assert len(got) == 13
    assert sentences.op6(spark, nothing(spark)).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] == "" and by[1]["n_removed"] == 0  # the same words, as a whole
    assert by[4]["text"] == "" and by[5]["text"] == " \n\t " and by[3]["text"] is None


def test_sentence_spans_of_equal_documents(spark):
    """Equal documents of any length go whole but for the first; what they share with others as a part stays if it is short."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    kinds = [" ".join(" ".join(word() for _ in range(rng.choice([1, 2, 5, 13, 31]))) + "." for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(100 * c + k, t) for k, t in enumerate(kinds) for c in range(3)]
    rows += [(1000 + k, f"{word()} {word()}. {t} {word()}.") for k, t in enumerate(kinds)]
    got = rows_of(sentences.op6(spark, spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert all(got[i]["text"] == t for i, t in rows if i < 100)
    assert all(got[i]["text"] == "" and got[i]["n_removed"] == got[i]["n_sentences"] for i, _ in rows if 100 <= i < 300)
    assert {i: (r["n_sentences"], r["n_removed"]) for i, r in got.items()} == brute_runs(rows)
    assert all(got[1000 + k]["text"] == rows[180 + k][1] for k, t in enumerate(kinds) if len(t.split()) < 20)


# 7 ---------------------------------------------------------------------------------------------------------------


def same_as_library(got, text, t):
    ids = t.encode(text or "", add_special_tokens=False).ids
    assert got["n_tokens"] == len(ids)
    assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pieces.default_path("word_bpe_49k.json"))
    got = rows_of(queries.op7_bpe(spark, SF))
    for i, text, _ in docs:
        same_as_library(got[i], text, t)
    texts = {r["doc_id"]: r["text"] for r in weird(spark).collect()}
    for r in bpe.op7(spark, weird(spark)).collect():
        same_as_library(r, texts[r["doc_id"]], t)
    assert bpe.op7(spark, nothing(spark)).count() == 0


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    bits = ["a", "B", "it's", "don't", "'", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "É", "é", "́", "中", "1", "23", ".", ",", "-", "#", "<|endoftext|>", "<|", "|>", " ", "ß", "İ", "x̸", "≠", "😀", "'re", "LL", "\x1c", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(bits) for _ in range(4000)) for _ in range(6)] + [" ".join(rng.choice(["alpha", "beta,", "gamma."]) for _ in range(3000))] * 2
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(pieces.default_path(name))
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        data = [x.encode() for x in texts]
        assert [x.tolist() for x in pieces.Pieces(pieces.default_path(name)).ids(data)] == want
        if name.startswith("word"):
            reuse = bpe.Reuse(pieces.default_path(name))
            assert [x.tolist() for x in reuse.add(data)] == want
            assert [x.tolist() for x in reuse.add(data[::-1])] == want[::-1]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    got = rows_of(queries.op8_licenses(spark, SF))
    assert len(got) == len(docs)
    for i, text, _ in docs:
        for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
            if f"\n{line}" in (text or ""):
                assert name in got[i]["licenses"].split(",")


def test_license_pruning_is_exact():
    """Size bounds lose nothing: every run of segments is compared with every template."""
    rng = random.Random(5)
    temps = {"a": "one two three four five.", "b": "one two three; four six seven eight.", "c": "nine ten."}
    t = licenses.Templates(temps, 0.6)
    words = "one two three four five six seven eight nine ten other".split()
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rng.randint(1, 25)))
        data = text.encode()
        segs = [re.findall(r"[a-z]+", s) for s in re.split(r"(?<=[.!?;])[ \t]+|[\r\n]+", text)]
        segs = [s for s in segs if s]
        best = 0.0
        for i in range(len(segs)):
            for j in range(i, len(segs)):
                w = [x for s in segs[i : j + 1] for x in s]
                grams = set(zip(w, w[1:], strict=False))
                for name, tt in temps.items():
                    own = re.findall(r"[a-z]+", tt)
                    own = set(zip(own, own[1:], strict=False))
                    if grams:
                        best = max(best, 2 * len(own & grams) / (len(own) + len(grams)))
        found = t.scan(data)
        assert bool(found) >= (best >= 0.75)
        assert all(d <= 1 for _, d, _, _ in found)


def test_licenses_awkward(spark):
    got = licenses.op8(spark, weird(spark)).collect()
    assert len(got) == 13 and all(r["n_matches"] == 0 for r in got)
    assert licenses.op8(spark, nothing(spark)).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_of_planted_words(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "ne", "so", "vi", "pu")]
    bad = ["grobb", "snarf", "vile"]
    rows, known = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randint(15, 120))]
        tox = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 4) if tox else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if rng.random() < 0.7:
            known.append((i, tox))
    truth = {i: any(b in t.split() for b in bad) for i, t in rows}
    got = rows_of(toxicity.op9(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(known, "doc_id bigint, toxic int")))
    held = [i for i, r in got.items() if r["held_out"]]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97


def brute_evidence(texts, text, d=0.75):
    """log P(toxic) - log P(ordinary) of each word, alone and after the word before it, from plain counts."""
    n = [Counter(), Counter()]
    for t, toxic in texts:
        w = t.split()
        n[toxic].update(zip(["", *w], w))
    n.append(n[0] + n[1])
    follows = [Counter(w for _, w in x) for x in n]
    types = [sum(x.values()) for x in follows]
    size = len(follows[2])
    even = d / max(types[2], d * (size + 1))
    shared = lambda w: max(follows[2][w] - d, 0) / types[2] + even
    whole = sum(map(shared, [*follows[2], "?"]))
    low = [lambda w, k=k: (max(follows[k][w] - d, 0) + sum(min(d, x) for x in follows[k].values()) * shared(w) / whole) / types[k] for k in (0, 1)]

    def p(k, c, w):
        seen = sum(x for (a, _), x in n[k].items() if a == c)
        own = low[k](w) if w in follows[2] else (low[0](w) + low[1](w)) / 2
        if not seen:
            return own
        kept = {b: x - d for (a, b), x in n[k].items() if a == c}
        return kept.get(w, 0) / seen + (1 - sum(kept.values()) / seen) * own

    words = text.split()
    clip = lambda x: max(-6.0, min(6.0, x))
    alone = [clip(math.log(low[1](w) / low[0](w))) if follows[1][w] else 0.0 for w in words]
    return alone, [clip(math.log(p(1, c, w) / p(0, c, w))) if n[1][c, w] else a for c, w, a in zip(["", *words], words, alone)]


@pytest.mark.parametrize("cached", [0, 12, 300_000])
def test_toxicity_counts_every_word_and_pair(spark, monkeypatch, cached):
    monkeypatch.setattr(toxicity, "MOST_CACHED", cached)
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 7 if cached == 12 else 1 << 20)
    monkeypatch.setattr(toxicity, "MOST_TOXIC_WORDS", 1 if cached == 12 else 1000)
    rng = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    texts = [(" ".join(rng.choice(common) if rng.random() < 0.7 else f"{'bad' if i % 3 == 0 else 'rare'}{rng.randrange(400)}" for _ in range(rng.randint(1, 25))), int(i % 3 == 0)) for i in range(160)]
    other = " ".join([texts[0][0], "never seen", texts[1][0], "never"])
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(1000, other), (1001, other)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id bigint, toxic int")
    got = rows_of(toxicity.score(docs, known, train="id < 120", calibrate="id between 120 and 999", keep=["doc_id"]).select("__row.doc_id", *toxicity.FEATURES))
    for i, t in [*((i, t) for i, (t, _) in enumerate(texts)), (1000, other), (1001, other)]:
        for kind, e in zip(("alone", "given"), brute_evidence(texts[:120], t), strict=True):
            assert got[i][f"{kind}_mean"] == pytest.approx(sum(e) / len(e), abs=1e-5)
            assert got[i][f"{kind}_strong"] == pytest.approx(math.log1p(sum(max(x - 1, 0) for x in e)), abs=1e-5)
            assert got[i][f"{kind}_very"] == pytest.approx(math.log1p(sum(max(x - 3, 0) for x in e)), abs=1e-5)
    kept = toxicity.reject_toxic(docs, known, threshold=1.1, train="id < 120", calibrate="id between 120 and 999")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def brute_ratio(texts, d=0.75):
    """A function of a text: log P(toxic) - log P(ordinary) by the two whole models, divided by its words; from plain counts."""
    n = [Counter(), Counter()]
    for t, toxic in texts:
        w = t.split()
        n[toxic].update(zip(["", *w], w))
    n.append(n[0] + n[1])
    follows = [Counter(w for _, w in x) for x in n]
    types = [sum(x.values()) for x in follows]
    size = len(follows[2])
    even = d / max(types[2], d * (size + 1))
    shared = lambda w: max(follows[2][w] - d, 0) / types[2] + even
    whole = sum(map(shared, [*follows[2], None]))
    seen, kinds = ([Counter() for _ in "ot"] for _ in "sk")
    for k in (0, 1):
        for (c, _), x in n[k].items():
            seen[k][c] += x
            kinds[k][c] += 1

    def p(k, c, w):
        low = (max(follows[k][w] - d, 0) + d * len(follows[k]) * shared(w) / whole) / types[k]
        return (max(n[k][c, w] - d, 0) + d * kinds[k][c] * low) / seen[k][c] if seen[k][c] else low

    def of(text):
        words = text.split()
        return sum(math.log(p(1, c, w) / p(0, c, w)) for c, w in zip(["", *words], words)) / max(len(words), 1)

    return of


@pytest.mark.parametrize("cached", [0, 12, 300_000])
def test_toxicity_compares_two_whole_models(spark, monkeypatch, cached):
    """Words and pairs that only ordinary text holds, and those that none holds, are in the difference of the log-likelihoods (F3)."""
    monkeypatch.setattr(toxicity, "MOST_CACHED", cached)
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 7 if cached == 12 else 1 << 20)
    monkeypatch.setattr(toxicity, "MOST_TOXIC_WORDS", {0: 0, 12: 8}.get(cached, 1000))
    rng = random.Random(8)
    common = [f"w{i}" for i in range(12)]
    texts = [(" ".join(rng.choice(common) if rng.random() < 0.7 else f"{'bad' if i % 3 == 0 else 'rare'}{rng.randrange(60)}" for _ in range(rng.randint(1, 25))), int(i % 3 == 0)) for i in range(160)]
    others = ["rare1 rare2 rare3", "never seen", "w1", "", f"{texts[1][0]} never {texts[0][0]} w1 w1 w1", f"{texts[1][0]} never {texts[0][0]} w1 w1 w1"]
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(others)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id bigint, toxic int")
    got = rows_of(toxicity.score(docs, known, train="id < 120", calibrate="id between 120 and 999", keep=["doc_id"]).select("__row.doc_id", "ratio_mean"))
    of = brute_ratio(texts[:120])
    assert of("rare1 rare2 rare3") < -1 and len(got) == len(rows)
    for i, t in rows:
        assert got[i]["ratio_mean"] == pytest.approx(of(t), abs=1e-5)


def test_toxicity_hears_ordinary_words(spark):
    """Texts that differ only in words that no toxic text holds don't score alike (F3)."""
    rng = random.Random(9)
    texts = [(" ".join(rng.choice(["w1", "w2", "w3", "bad" if i % 3 == 0 else "good"]) for _ in range(20)), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(1000, "w1 never w2 never bad"), (1001, "w1 good w2 good bad")], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id bigint, toxic int")
    got = rows_of(toxicity.op9(spark, docs, known))
    assert got[1001]["score"] < got[1000]["score"]


def test_toxicity_cache_is_bounded(spark, monkeypatch):
    """However high the counts are, no more rows than the bound are held."""
    table = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 1000 + 1000).alias("n"), F.lit(0.5).cast("float").alias("e"), F.when(F.col("id") % 2 == 0, 0.25).cast("float").alias("alone"))
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 12)
    for most in (0, 7, 100, 400):
        monkeypatch.setattr(toxicity, "MOST_CACHED", most)
        model = toxicity.cache(table)
        held = sorted([*model.words.tolist(), *model.pairs.tolist()])
        assert len(held) <= most and held == list(range(400 - len(held), 400)) and (most < 400 or len(held) == 400)


def shuffle_files(spark):
    return {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_toxicity_leaves_nothing_on_disk(spark, monkeypatch):
    """Steps take the disk one after the other: none leaves shuffle files, and the buckets go. Any number of slices gives the same features (F2)."""
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(toxicity, "MOST_CACHED", 5)
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(20))) for i in range(60)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    before, tables, found = shuffle_files(spark), spark.catalog.listTables(), []
    for slices in (1, 3):
        monkeypatch.setattr(toxicity, "SLICES", slices)
        found.append(toxicity.score(docs, known, keep=["doc_id"]))
        until = time.time() + 20  # files are removed in the background
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before and spark.catalog.listTables() == tables
        found[-1] = rows_of(found[-1].select("__row.doc_id", *toxicity.FEATURES))
        before |= shuffle_files(spark)  # the result's own
    assert spark.conf.get(common.FREED) == "false" and len(found[0]) == 60
    for i, r in found[0].items():
        assert list(r[1:]) == pytest.approx(list(found[1][i][1:]), abs=1e-9)


def test_toxicity_driver_holds_a_bounded_share(spark, monkeypatch):
    """Of a million frequent rows the driver gets and ships less than 16 MB beside the filter (F1)."""
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 12)
    some = lambda x: F.lit(x).cast("float")
    table = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), (2 + F.col("id") % 1000).alias("n"), some(0.5).alias("e"), some(0.25).alias("alone"), some(0.1).alias("ratio"), some(None).alias("after"))
    model = toxicity.cache(table, ("ratio", "after"))
    assert 0 < sum(x.nbytes for x in (model.words, model.word_evidence, model.pairs, model.pair_evidence)) < 16 << 20


def test_toxicity_held_out(spark):
    """Held-out accuracy on the test tables (0.99 at sf0.1)."""
    sf = "/root/testdata/sf0.01"
    known = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall())
    got = queries.op9_toxicity(spark, sf).collect()
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert sum(p == y for p, y in held) / len(held) > 0.93


def test_toxicity_awkward(spark):
    got = toxicity.op9(spark, weird(spark), labels(spark)).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.op9(spark, nothing(spark), labels(spark)).count() == 0
    assert toxicity.op9(spark, weird(spark), labels(spark).limit(0)).count() == 13
    kept = toxicity.reject_toxic(weird(spark), labels(spark), threshold=1.1)
    assert kept.columns == weird(spark).columns and kept.count() == 13


# 10 --------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.95):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in good], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = x @ x.T >= cosine
    np.fill_diagonal(g, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.array([min([label[k], *label[g[k]]]) for k in range(len(good))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, _ in rows}
    out.update({good[k][0]: (int(g[k].sum()), int(label[k])) for k in range(len(good))})
    return out


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(c * 100 + i, (centre + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])).tolist()) for i in range(40)]
    rows += [(5000 + i, rows[3][1]) for i in range(60)] + [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [None] * 16), (6004, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_awkward(spark):
    """Several dimensions, repeated and null ids, clashing columns."""
    rng = np.random.default_rng(3)
    base = {d: rng.normal(size=d) for d in (3, 5, 16)}
    rows = [(100 * d + i, (v + rng.normal(size=d) * 0.1).tolist()) for d, v in base.items() for i in range(9 * (d % 4 + 1))]
    rows += [(7, base[3].tolist()), (8, (2 * base[3]).tolist()), (9, [1.0, 0.0]), (10, [3.0, 0.0]), (11, [1.0])]
    want = brute_vectors([r for r in rows if len(r[1]) == 3]) | brute_vectors([r for r in rows if len(r[1]) == 5]) | brute_vectors([r for r in rows if len(r[1]) == 16]) | brute_vectors([r for r in rows if len(r[1]) < 3 and r[0] != 11]) | {11: (0, 11)}
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in [*rows, (None, [1.0, 0.0])]], "vec_id bigint, embedding array<double>, id int, v string, comp int")
    got = vectors.op10(spark, df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    twice = vectors.op10(spark, spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert len(twice) == 4 and {r["component_id"] for r in twice} == {1}


def test_vectors_of_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op10_vectors(spark, SF).collect()}
    assert got == brute_vectors(rows)


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "REPLICAS", 70)
    monkeypatch.setattr(vectors, "PER_PIVOT", 20)
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.25).tolist()) for i in range(400)]
    got = {r["id"]: (r["n_links"], r["component"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == brute_vectors(rows)


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = frame.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "pii", "bpe"]
    before = {r["doc_id"]: r["text"] for r in frame.collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pieces.default_path("word_bpe_49k.json"))
    item_rows = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        rows = {r["doc_id"]: r for r in frame.collect()}
        assert set(rows) <= set(before) and frame.count() == len(rows)
        if name != "bpe":
            assert frame.columns == names
        if name == "near_duplicates":
            comp = brute_components(list(before.items()), 5, 80)
            assert set(rows) == {i for i, c in comp.items() if i == c}
        if name == "decontaminate":
            for i, x in before.items():
                n, hit, *_ = brute_hits(x, item_rows)
                assert (i in rows) == (hit <= 0.5 * n)
                if i in rows:
                    assert (rows[i]["text"] == x) if not hit else brute_hits(rows[i]["text"], item_rows)[1] < hit
        if name == "pii":
            assert set(rows) == set(before) and all((rows[i]["text"] == x) or base(x) for i, x in before.items())
            assert not any(re.search(KINDS["email"], r["text"] or "") for r in rows.values())
        if name == "bpe":
            assert set(rows) == set(before)
            for i, x in before.items():
                assert list(rows[i]["ids"]) == t.encode(x or "", add_special_tokens=False).ids
        else:
            before = {i: r["text"] for i, r in rows.items()}


def test_pipeline_toxicity_hears_ordinary_words(spark, tmp_path):
    """The classes differ only in words that no toxic text holds and in words that occur once: the stage tells them apart (F4)."""
    rng = random.Random(10)
    plain = [f"w{i}" for i in range(8)]
    rows, known = [], []
    for i in range(800):
        tox = int(rng.random() < 0.5)
        w = [rng.choice(plain) if rng.random() < 0.6 else f"u{i}x{j}" if tox else rng.choice(["good", "kind", "fair", "mild"]) for j in range(30)]
        rows.append((i, " ".join(w)))
        known.append((i, tox))
    spark.createDataFrame(known, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path)).collect()}
    held = [(i, tox) for i, tox in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in kept) != tox for i, tox in held) / len(held) > 0.97


def test_pipeline_awkward(spark, tmp_path):
    frame = weird(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, SF).write.parquet(str(tmp_path / f"{k}"))
        frame = spark.read.parquet(str(tmp_path / f"{k}"))
    assert frame.count() == len({r["doc_id"] for r in frame.collect()}) > 5
    frame = nothing(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, SF).write.parquet(str(tmp_path / f"none{k}"))
        frame = spark.read.parquet(str(tmp_path / f"none{k}"))
    assert frame.count() == 0


def test_worker_holds_one_operator():
    from reelquery.llm import worker

    made = []
    make = lambda name: lambda: made.append(name) or [name]
    a = worker.remembered("a", make("a"))
    assert worker.remembered("a", make("a")) is a
    worker.remembered("b", make("b"))
    worker.remembered("a", make("a"))
    assert made == ["a", "b", "a"]
    assert list(worker.tidy(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]
    worker.remembered("a", make("a"))
    assert made == ["a", "b", "a", "a"]
    worker.forget()
