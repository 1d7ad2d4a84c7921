"""Known inputs and results of the page operators."""

from __future__ import annotations

import json
import sys
import types
import zipfile
from io import BytesIO

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import decode as D
from vellum.functions import geometry as G
from vellum.functions import pixels as X
from vellum.functions import text as T
from vellum.operators import cascade as C
from vellum.operators import evaluate as E
from vellum.operators import layout as L
from vellum.operators import page_rules as R
from vellum.operators import rule_pack as P
from vellum.sources import readers, sinks
from vellum.streaming import pages as stream

BOX = "page_id bigint, det_id int, class_name string, x0 int, y0 int, x1 int, y1 int, char_count double"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def page(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id bigint, line_idx bigint, text string")


def texts(df):
    return [r.text for r in df.orderBy("line_idx").collect()]


@pytest.mark.parametrize(("given_", "wanted"), [
    ("年間計画 22222222 ====（（（（", "年間計画 2222 ===（（（"),
    ("川の名(甲」という。)という。)です", "川の名(甲という。)という。です"),
    ("花という。という。は赤い", "花という。は赤い"),
    ("単又は乙は調示をする", "甲又は乙は開示をする"),
])
def test_sanitize(spark, given_, wanted):
    assert one(spark, given_, T.sanitize) == wanted


@pytest.mark.parametrize(("given_", "wanted"), [
    ("第7条(川の名)", "第7条（川の名）"),
    ("第7条（川の名） 第3", "第7条（川の名）"),
    ("第8条（山）にある", "第8条（山）"),
    ("(花)のようにさいている", "(花)"),
    ("(花)のような赤い実", "(花)のような赤い実"),
    ("（2）水を飲むとき", "(2)水を飲むとき"),
])
def test_clean_line(spark, given_, wanted):
    assert one(spark, given_, T.clean_line) == wanted


def test_decoration(spark):
    for t in ("-", "1,", "", "   ", "。、"):
        assert one(spark, t, T.is_decoration)
    for t in ("目次", "附則", "(税目)", "第1章総則"):
        assert not one(spark, t, T.is_decoration)


def test_page_rules(spark):
    assert texts(R.trim_context(page(spark, "第4章川と山第", "(花)"))) == ["第4章川と山", "(花)"]
    assert texts(R.merge_split_digits(page(spark, "春の山8", "川の水"))) == ["春の山川の水"]
    assert texts(R.join_hyphenated(page(spark, "A long riv-", "er runs by."))) == ["A long river runs by."]
    for a, b in (("a last word-", "第9条 花"), ("number 4-", "goes on"), ("sheet-", "2 of 5"), ("part-", "山")):
        assert texts(R.join_hyphenated(page(spark, a, b))) == [a, b]
    lines = page(spark, "-", "2,", "○川の名の一覧", "花の名", "花の名", "第5章山")
    assert texts(R.structural_rules(lines)) == ["○川の名の一覧", "花の名", "第5章山"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.sampled_from(["ab-", "cd", " ef-", "1.x-", "gh- ", "-", ""]), min_size=1, max_size=9))
def test_hyphen_islands_equal_a_sequential_pass(spark, lines):
    out: list[str] = []
    for x in lines:
        head = out[-1].rstrip() if out else ""
        here = x.lstrip()
        if out and len(head) > 1 and head[-1] == "-" and head[-2].isalpha() and here[:1].isalpha() and not here.startswith("1."):
            out[-1] = head[:-1] + here
        else:
            out.append(x)
    assert texts(R.join_hyphenated(page(spark, *lines))) == out


def test_user_rules(spark):
    assert texts(P.apply_dictionary(page(spark, "red and blue"), P.dictionary([{"from": "red", "to": "blue"}, {"from": "blue and", "to": "green or"}]))) == ["green or blue"]
    assert texts(P.apply_dictionary(page(spark, "A"), P.dictionary({"replacements": [{"from": "", "to": "x"}, {"from": "A", "to": "B"}]}))) == ["B"]
    pack = P.rule_pack({"line_replacements": [{"from": "x", "to": "y"}], "merge_rules": [{"left_suffix": "ab", "right_prefix": "cd", "drop_right_prefix_chars": 1}], "collapse_duplicate_adjacent_lines": True})
    assert texts(P.apply_pack(page(spark, "xab", "cde", "y", "y"), pack)) == ["yabde", "y"]


def test_geometry(spark):
    size = spark.createDataFrame([(100, 10), (33, 20), (7, 0)], "w int, h int")
    assert [r.n for r in size.select(G.char_count(F.col("w"), F.col("h")).alias("n")).collect()] == [25, 4, 18]
    size = spark.createDataFrame([(90, 10), (110, 10), (190, 10), (104, 10), (180, 10), (182, 10)], "w int, h int")
    assert [r.n for r in size.select(G.char_bucket(F.col("w"), F.col("h")).alias("n")).collect()] == [3, 2, 100, 2, 2, 100]
    boxes = spark.createDataFrame([(1, i, "line_main", *b, 3.0) for i, b in enumerate([(2, 2, 5, 4), (8, 2, 11, 4), (0, 1, 2, 5)])], BOX)
    kept = L.crop_boxes(boxes, F.lit(10), F.lit(10), 1).orderBy("det_id").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.is_vertical) for r in kept] == [(1, 1, 6, 5, False), (0, 0, 3, 6, True)]
    raw = spark.createDataFrame([(1, [7, 3], [[4.0, 6.0, 9.0, 8.0], [5.0, 5.0, 7.0, 7.0]], [0.1, 0.7])], "page_id bigint, class_ids array<bigint>, boxes array<array<double>>, scores array<double>")
    r = L.build_detections(L.explode_raw(raw), 0.2, F.lit(2.0), F.lit(1.0)).collect()
    assert [(x.x0, x.y0, x.x1, x.y1, x.class_name) for x in r] == [(10, 5, 14, 7, "line_caption")]


def test_reading_order(spark):
    rows = [("h1", 50, 4, 90, 9), ("v1", 80, 1, 84, 60), ("h2", 3, 31, 44, 39), ("v2", 12, 2, 17, 50), ("h3", 60, 31, 99, 39)]
    df = spark.createDataFrame([(1, i, *r, r[0][0] == "v") for i, r in enumerate(rows)], "page_id int, det_id int, name string, x0 int, y0 int, x1 int, y1 int, is_vertical boolean")
    assert [r.name for r in L.reading_order(df).orderBy("line_idx").collect()] == ["v1", "v2", "h1", "h2", "h3"]


def test_decode(spark):
    assert one(spark, [1, 2, 0, 3], lambda c: D.decode_indices(c, "あいう"), "array<int>") == "あい"
    assert one(spark, [[0.1, 0.9, 0.2], [0.8, 0.1, 0.1]], lambda c: D.decode_logits(c, "あい"), "array<array<double>>") == "あ"
    r = one(spark, [[0.0, 9.0, 0.0], [0.0, 0.0, 9.0], [0.0, 0.1, 0.0], [0.0, 9.0, 0.0]], lambda c: D.decode_with_confidence(c, "あい"), "array<array<double>>")
    assert r.text.startswith("あい") and 0.5 < r.mean_confidence <= 1


def test_cascade(spark):
    stub = lambda text: lambda df: df.withColumns({"text": F.lit(text), "mean_confidence": F.lit(0.9)})
    rows = spark.createDataFrame([(1, i, "line_main", 0, 0, 9, 9, c) for i, c in enumerate((3.0, 2.0, 100.0))], BOX)
    out = C.cascade(rows, stub("x" * 25), stub("x" * 45), stub("ok"))
    assert [r.text for r in out.collect()] == ["ok"] * 3


def test_quality_prefers_text(spark):
    df = spark.createDataFrame([("川の水は冷たい",), ("44 ((7 44 ((7",)], "t string").select(T.quality_score(F.col("t"), F.lit(0.7)).alias("s"))
    good, bad = (r.s for r in df.collect())
    assert good > bad


def test_rerank_at_exactly_the_margin(spark):
    """50 equal letters score 0.85 - 1.88 = -1.03, the margin below an empty text, which so does not win."""
    df = spark.createDataFrame([("b" * 50, 0.85, "", 0.5)], "a string, c double, b string, e double")
    best = C.rerank(F.array(F.struct(F.col("a").alias("text"), F.col("c").alias("mean_confidence")), F.struct(F.col("b").alias("text"), F.col("e").alias("mean_confidence"))))
    r = df.select(best.alias("r")).first().r
    assert r.text == "b" * 50 and round(r.score, 9) == -1.03


def test_runs_of_blanks_can_be_no_long_runs(spark):
    df = spark.createDataFrame([(" " * 6,), ("a" * 6,), (" a  b",)], "t string")
    scores = lambda **kw: [round(r.s, 9) for r in df.select(T.quality_score(F.col("t"), F.lit(0.7), **kw).alias("s")).collect()]
    assert scores() == [0.58, 0.58, 0.7] and scores(blank_runs=False) == [0.7, 0.58, 0.7]


def test_pages_are_drawn_on_all_cores(spark, sf):
    """The ids come in one small file; what is made of them does not stay in one task."""
    from vellum.plans import views as V

    drawn = V.v_packed(spark, sf)
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_lines_are_cut_in_one_walk(spark, tmp_path):
    """Pieces of 40 and 14 characters; a line of 700,000 characters costs a walk over it, not one for each piece."""
    import time

    from vellum.plans import views as V

    long = "".join(chr(97 + k % 26) for k in range(700_000))
    texts = [None, "", "a", "a" * 40, "a" * 41, "a" * 39 + "1b", "x" * 80 + "\n\n" + "é" * 41, "ab😀" * 30, "a\r b" * 20, long]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, n, x) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    letter = lambda x: x.isascii() and x.isalpha()
    cuts = lambda x, size: [x[k : k + size] for k in range(0, len(x), size)] or [""]
    wrapped = {(i, n * 100000 + k, p + ("-" if k * 40 + 40 < len(x) and letter(x[k * 40 + 39]) and letter(x[k * 40 + 40]) else "")) for i, n, x in lines for k, p in enumerate(cuts(x, 40))}
    cjk = {(i, n * 100000 + k, p.translate(str.maketrans(V.CJK_FROM, V.CJK_TO))) for i, n, x in lines for k, p in enumerate(cuts(x, 14))}
    begun = time.time()
    assert {tuple(r) for r in V.v_wrapped(spark, str(tmp_path)).collect()} == wrapped
    assert {tuple(r) for r in V.v_cjk(spark, str(tmp_path)).collect()} == cjk
    assert time.time() - begun < 30


def test_runs_and_brackets_against_plain_code(spark):
    rows = ["", "a", "abc", "aaab", "))((", "(a)b)）「」」（", "7777777 !!!!", "  \n\n\n\n\n x", "😀😀😀😀😀(😀", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.longest_run(F.col("t")).alias("run"), T.excess_run(F.col("t"), 3).alias("over"), T.unmatched_brackets(F.col("t")).alias("bad")).collect()

    def plain(t):
        best, stack, bad, pairs = 1, [], 0, {c: o for o, c in T.BRACKETS}
        for i, x in enumerate(t):
            n = next((k for k in range(1, i + 1) if t[i - k] != x), i + 1)
            best = max(best, n)
            if x in pairs.values():
                stack.append(x)
            elif x in pairs and stack and stack[-1] == pairs[x]:
                stack.pop()
            elif x in pairs:
                bad += 1
        return best, max(best - 3, 0), bad + len(stack)

    for r in got:
        assert (r.run, r.over, r.bad) == ((1, 0, 0) if r.t is None else plain(r.t)), r


def test_chunks_of_every_length_longest_first(spark):
    import random
    import re

    draw = random.Random(3)
    rows = ["".join(draw.choice("ab" if k % 2 else "a😀é") for _ in range(draw.randrange(60))) for k in range(400)] + ["ab" * 7, "x" * 31, "abcdefghij" * 5, "😀é" * 5]
    pattern = re.compile("(?s)" + "|".join(rf"(.{{{n}}})\{i}{{2,}}" for i, n in enumerate(range(10, 1, -1), 1)))
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.collapse_chunks(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == pattern.sub(lambda m: 2 * m[m.lastindex], r.t), r.t


def test_tensors():
    import numpy as np

    image = X.crop(bytes([255, 0, 0, 0, 0, 255]), 1, 2, 0, 0, 1, 2)
    assert np.allclose(X.recognizer_input(image, 2, 1).ravel(), [-1, 1, -1, -1, 1, -1])
    with pytest.raises(ValueError):
        X.crop(b"123", 2, 2, 0, 0, 1, 1)


def test_outputs(spark):
    lines = spark.createDataFrame([(1, 0, 1, 2, 3, 9, "abc", 0.9, True), (1, 1, 4, 4, 9, 6, "<x&\"'>", 0.8, False)], "page_id bigint, line_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double, is_vertical boolean")
    pages = spark.createDataFrame([(1, 100, 200, "in/p.png", "p.png"), (2, 5, 5, "q", "q")], "page_id bigint, width int, height int, path string, name string")
    docs = {r.page_id: sinks.pretty_json(r.json) for r in sinks.page_json(lines, pages).collect()}
    assert '"isVertical": "true"' in docs[1] and '"img_width": 100' in docs[1]
    xml = {r.page_id: r.xml for r in sinks.page_xml(lines, pages).collect()}
    assert 'STRING="&lt;x&amp;&quot;&apos;&gt;" ORIENT="horizontal"' in xml[1] and "LINE" not in xml[2]
    body = sinks.page_docx(spark.createDataFrame([(1, "A & B < C > D\nE")], "page_id bigint, text string")).first().docx
    with zipfile.ZipFile(BytesIO(body)) as z:
        part = z.read("word/document.xml").decode()
    assert "A &amp; B &lt; C &gt; D" in part and part.count("<w:p>") == 2


def test_reports(spark, tmp_path):
    truth = spark.createDataFrame([("a.txt", "one two"), ("b.txt", "x")], "relpath string, text string")
    pred = spark.createDataFrame([("s", "a.txt", "one too"), ("t", "a.txt", "one two"), ("t", "b.txt", "x")], "system string, relpath string, text string")
    metrics, missing = E.file_metrics(truth, pred), E.missing_files(truth, pred)
    systems = E.with_missing(E.system_metrics(metrics), missing)
    assert [(r.system, r.matched, r.missing) for r in E.ranked(systems).orderBy("place").collect()] == [("t", 2, 0), ("s", 1, 1)]
    with pytest.raises(ValueError, match="s: b.txt"):
        E.require_all(missing)
    E.require_all(missing.limit(0))
    assert sinks.summary_lines(systems, "t")[1:] == ["t,0.000000,0.000000,+0.000000,+0.000000", "s,0.142857,0.500000,+0.142857,+0.500000"]
    assert E.deltas(systems, "nobody").count() == 0
    timing = E.timed({"first": truth, "second": pred}, lambda name, df: df.count())
    sinks.timing_csv(timing, f"{tmp_path}/t")
    back = readers.timings(spark, f"{tmp_path}/t")
    assert [r.stem for r in back.orderBy("stem").collect()] == ["first", "second"] and back.where("wall_seconds >= 0").count() == 2
    report = sinks.combined_report("Both", timing, systems, missing, "basic")
    assert "- files: 2" in report and "| t | 2 | 0 | 0.000000" in report and "Missing from s" in report and report.index("| t |") < report.index("| s |")
    sinks.metrics_csv(metrics, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns[:4] == ["system", "file", "cer", "wer"]
    assert E.page_totals(truth.withColumn("page_id", F.lit(1)), 2.0, 5.0).first().ratio == 2.5


def test_settings_and_yaml(spark, tmp_path, monkeypatch):
    readers.check_settings("text", None)
    for bad in (("", None), ("x", " ")):
        with pytest.raises(ValueError):
            readers.check_settings(*bad)
    yaml = types.ModuleType("yaml")  # YAML's flow style is JSON's, so the reader can be tried without the package
    yaml.safe_load = json.loads
    monkeypatch.setitem(sys.modules, "yaml", yaml)
    assert readers.charset('{"model": {"charset_train": ["ab", "c"]}}') == ["a", "b", "c"]
    assert P.dictionary('[{"from": "a", "to": "b"}, {"from": "", "to": "c"}]') == [("a", "b")]
    assert P.rule_pack('{"merge_rules": [{"left_suffix": "a", "right_prefix": "b"}]}').merge_rules == (P.MergeRule("a", "b", 0),)
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(RuntimeError, match="yaml"):
        P.dictionary("[]")


def test_yaml_package(spark):
    pytest.importorskip("yaml")
    assert readers.charset("model:\n  charset_train: [ab, c]\n") == ["a", "b", "c"]
    assert P.dictionary("- {from: a, to: b}\n- {from: '', to: c}\n") == [("a", "b")]
    assert P.rule_pack("merge_rules:\n- {left_suffix: a, right_prefix: b}\n").merge_rules == (P.MergeRule("a", "b", 0),)


def test_words_without_limit(spark):
    a, b = " ".join(f"w{i}" for i in range(40_000)), " ".join(f"w{i}" for i in range(39_990))
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.word_distance(F.col("a"), F.col("b")).alias("d")).first().d == 10


def test_odd_addresses(spark):
    assert one(spark, "http://exa mple/a b", T.url_stem) == "host_page"


def test_strict_crops(spark):
    boxes = spark.createDataFrame([(1, 0, "line_main", 0, 0, 5, 5, 3.0), (1, 1, "line_main", -1, 0, 5, 5, 3.0)], BOX)
    assert L.crop_boxes_strict(boxes.where("det_id = 0"), F.lit(9), F.lit(9)).count() == 1
    with pytest.raises(Exception, match="invalid crop box"):
        L.crop_boxes_strict(boxes, F.lit(9), F.lit(9)).collect()


def test_evaluation(spark):
    truth = spark.createDataFrame([("a.txt", "one two  three"), ("b.txt", "x")], "relpath string, text string")
    pred = spark.createDataFrame([("s", "a.txt", "one too three")], "system string, relpath string, text string")
    m = E.file_metrics(truth, pred).first()
    assert (m.char_errors, m.word_errors, m.word_total) == (1, 1, 3)
    assert [(r.system, r.relpath) for r in E.missing_files(truth, pred).collect()] == [("s", "b.txt")]


def test_stems(spark):
    assert one(spark, "ftp://river.test/law/77QX?page=2#top", T.url_stem) == "law_77QX"
    assert one(spark, "~Two rivers (old)", T.stem) == "Two_rivers_old"
    for a, b in (("blue\t \tsea\rred", "blue sea\nred"), ("\n\n sun \n moon", "sun\nmoon"), ("x\n\n\ny\n\n\n\nz", "x\n\ny\n\nz")):
        assert one(spark, a, T.clean_truth) == b


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("x\ny")
    (tmp_path / "p.PNG").write_bytes(b"1")
    (tmp_path / "q.gif").write_bytes(b"1")
    assert [(r.relpath, r.text) for r in readers.whole_texts(spark, str(tmp_path)).collect()] == [("d/a.txt", "x\ny")]
    assert readers.collect_images(spark, folder=str(tmp_path)).count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in readers.evaluation_images(spark, str(tmp_path)).collect()] == ["p.PNG"]
    with pytest.raises(ValueError):
        readers.evaluation_images(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        readers.collect_images(spark)
    assert readers.system_argument("a=b=c") == ("a", "b=c")
    assert readers.charset({"model": {"charset_train": "あい"}}) == ["あ", "い"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "-\nA long riv-\ner runs by"), (2, "x\nx")], "page_id bigint, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream.structured(stream.texts(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.page_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "A long river runs by"}
