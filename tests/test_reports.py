"""Page files, the evaluation cube, reports with differences, order by equal boxes, accuracy of a stream, work from other folders."""

from __future__ import annotations

import os
import subprocess
import sys
import zipfile
from io import BytesIO
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vellum.operators import evaluate as E
from vellum.operators import layout as L
from vellum.sources import page_files, sinks
from vellum.streaming import evaluation

LINES = "page_id bigint, line_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double, is_vertical boolean"
PAGES = "page_id bigint, width int, height int, path string, name string"


def lines(spark):
    return spark.createDataFrame([(1, 0, 1, 2, 3, 9, "abc", 0.9, True), (1, 1, 4, 4, 9, 6, "<x", 0.8, False)], LINES)


def named(spark, *names):
    return spark.createDataFrame([(i, 100, 200, f"in/{n}", n) for i, n in enumerate(names, 1)], PAGES)


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.relative_to(folder).parts[0].startswith(("_", "."))}


def test_page_files(spark, tmp_path):
    pages = named(spark, "p.png", "same", "same", "same~2", "same-2")
    found = {(r.page_id, r.kind): r.path for r in sinks.write_page_files(lines(spark), pages, f"{tmp_path}/out").collect()}
    assert len(found) == len(set(found.values())) == 20
    assert files(tmp_path / "out") == {os.path.relpath(p, tmp_path / "out") for p in found.values()}
    assert [os.path.basename(found[i, "txt"]) for i in range(1, 6)] == ["p.txt", "same~2.txt", "same~3.txt", "same~2~4.txt", "same-2.txt"]
    body = {k: Path(v).read_bytes() for k, v in found.items()}
    assert body[1, "txt"] == b"abc\n<x" and b'"id": 1' in body[1, "json"] and b"&lt;x" in body[1, "xml"] and body[2, "txt"] == b""
    assert zipfile.ZipFile(BytesIO(body[3, "docx"])).namelist()[-1] == "word/document.xml"
    again = sinks.write_page_files(lines(spark), pages, f"{tmp_path}/out", ("txt",))
    assert again.count() == 20 and len(files(tmp_path / "out")) == 20  # written over, listed once
    sinks.write_artifacts(lines(spark), pages, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/json").count() == 5


def test_documents_equal_those_made_one_by_one(spark):
    pages = named(spark, "a", "b")
    made = {r.page_id: r for r in sinks.page_documents(lines(spark), pages).collect()}
    for name, df in (("json", sinks.page_json(lines(spark), pages)), ("xml", sinks.page_xml(lines(spark), pages))):
        assert {r.page_id: r[name] for r in df.collect()} == {i: r[name] for i, r in made.items()}
    assert made[1].txt == "abc\n<x" and made[2].txt == "" and "<w:p/>" in made[2].docx_body


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    body = F.when(F.col("id") == 19, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    rows = spark.range(0, 20, 1, 4).select(F.col("id").alias("page_id"), F.lit("txt").alias("kind"), F.concat("id", F.lit(".txt")).alias("name"), body.alias("body"))
    with pytest.raises(Exception, match="broken"):
        page_files.write_files(rows, f"{tmp_path}/out")
    assert files(tmp_path / "out") == set() and page_files.manifest(spark, f"{tmp_path}/out").count() == 0
    good = rows.where("id < 19")
    assert page_files.write_files(good, f"{tmp_path}/out").count() == len(files(tmp_path / "out")) == 19


def test_a_repeated_task_counts_once(spark, tmp_path):
    out = f"{tmp_path}/out"
    writer = page_files.PageFileWriter({"path": out, "job": "j"})
    rows = [{"page_id": 1, "kind": "txt", "name": "a.txt", "body": b"a"}]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))  # both attempts end, one is committed
    assert first.name != second.name
    writer.commit([second, None])
    assert files(out) == set() and page_files.manifest(spark, out).count() == 0
    page_files.publish(spark, out, "j")
    assert [(r.page_id, r.kind) for r in page_files.manifest(spark, out).collect()] == [(1, "txt")] and files(out) == {"a.txt"}
    assert not list(Path(out).glob("_staging*"))


def systems(spark):
    truth = spark.createDataFrame([("a.txt", "One, two"), ("b.txt", "é x"), ("c.txt", "")], "relpath string, text string")
    pred = spark.createDataFrame([("s", "a.txt", "One two"), ("t", "a.txt", "One, two"), ("t", "b.txt", "e  x"), ("t", "c.txt", "")], "system string, relpath string, text string")
    return truth, pred


def test_cube(spark):
    truth, pred = systems(spark)
    rows = {(r.level, r.system): r for r in E.cube(truth, pred, baseline="t").collect()}
    assert len(rows) == 9 and rows["none", "s"].char_errors == 1 and rows["strict", "s"].char_errors == 0 and rows["none", "t"].char_errors == 2 and rows["basic", "t"].char_errors == 1
    for level in ("none", "basic", "strict"):
        one = {r.system: r for r in E.with_missing(E.system_metrics(E.file_metrics(truth, pred, level)), E.missing_files(truth, pred)).collect()}
        for name, r in one.items():
            c = rows[level, name]
            assert (c.matched, c.missing, c.char_errors, c.char_total, c.word_errors, c.word_total, c.cer, c.wer) == (r.matched, r.missing, r.char_errors, r.char_total, r.word_errors, r.word_total, r.cer, r.wer)
            assert c.delta_cer == r.cer - one["t"].cer
        total = rows[level, None]
        assert total.is_total and total.matched == 4 and total.missing == 2 and total.char_errors == sum(r.char_errors for r in one.values())
    assert all(r.delta_cer is None for r in E.cube(truth, pred).collect())
    report = sinks.cube_report(E.cube(truth, pred, baseline="t"), "t")
    assert report.count("| all | 4 | 2 |") == 3 and "## strict" in report and "ΔCER" in report and "ΔCER" not in sinks.cube_report(E.cube(truth, pred))


def test_reports_with_differences(spark):
    truth, pred = systems(spark)
    found, missing = E.system_metrics(E.file_metrics(truth, pred)), E.missing_files(truth, pred)
    report = sinks.markdown_report(found, missing, "basic", baseline="t")
    assert "| s | 1 | 2 | 0.125000 | 0.500000 | +" in report and "Baseline: t" in report and "- b.txt" in report
    timing = lambda *s: spark.createDataFrame([("x", v) for v in s], "stem string, wall_seconds double")
    both = sinks.comparison_report("Two engines", {"s": timing(1.0, 3.0), "t": timing(4.0)}, found, missing, "basic", "t")
    assert "| s | 2 | 4.000 | 2.000 | 2.00 |" in both and "| t | 1 | 4.000 | 4.000 | 1.00 |" in both and "ΔWER" in both


def test_too_many_systems_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_SYSTEMS", 3)
    many = spark.range(4).selectExpr("string(id) as system", "double(id) as cer")
    assert E.ranked(many.where("id < 3")).count() == 3
    with pytest.raises(Exception, match="more than 3 systems"):
        E.ranked(many).collect()


def test_order_by_equal_boxes(spark):
    box = "page_id int, det_id int, x0 int, y0 int, x1 int, y1 int"
    rows = spark.createDataFrame([(1, 0, 0, 30, 9, 39), (1, 1, 0, 10, 9, 19), (1, 2, 0, 30, 9, 39), (1, 3, 5, 5, 6, 6), (2, 0, 0, 10, 9, 19)], box).withColumn("is_vertical", F.lit(False))
    ordered = L.reading_order(rows.where("det_id <> 3"))
    assert {(r.page_id, r.det_id): r.place for r in L.restore_order(rows, ordered).collect()} == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): None, (2, 0): 0}


def test_accuracy_of_a_stream(spark, tmp_path):
    truth, pred = systems(spark)
    folder = f"{tmp_path}/in"
    pred.where("system = 's'").coalesce(1).write.mode("append").parquet(folder)
    pred.where("system = 't'").coalesce(1).write.mode("append").parquet(folder)
    pred.coalesce(1).write.mode("append").parquet(folder)  # all of it once more
    run = lambda: evaluation.measured(evaluation.predictions(spark, folder, 1), truth, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    wanted = {tuple(r) for r in E.system_metrics(E.file_metrics(truth, pred)).collect()}
    assert {tuple(r) for r in evaluation.totals(spark, f"{tmp_path}/out").collect()} == wanted
    late = spark.createDataFrame([("s", "b.txt", "é x"), ("s", "a.txt", "something else")], "system string, relpath string, text string")
    late.coalesce(1).write.mode("append").parquet(folder)
    run()
    wanted = {tuple(r) for r in E.system_metrics(E.file_metrics(truth, pred.unionByName(late.where("relpath = 'b.txt'")))).collect()}
    assert {tuple(r) for r in evaluation.totals(spark, f"{tmp_path}/out").collect()} == wanted


def test_intermediate_tables_are_cleared(spark):
    from vellum import session

    session.clear(spark)
    table = session.written(spark.range(5), "five")
    path = session._written[-1].removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path.replace("//", "/", 1))
    assert session.clear(spark) == 1 and not os.path.exists(path.replace("//", "/", 1)) and session.clear(spark) == 0


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from vellum.session import session
spark = session(2)
from pyspark.sql import functions as F
from vellum.operators import bands
from vellum.sources import images, readers, sinks
lines = spark.createDataFrame([(1, 0, 1, 2, 3, 9, "abc", 0.9, True)], {lines!r})
pages = spark.createDataFrame([(1, 9, 9, "p", "p")], {pages!r})
print(sinks.write_page_files(lines, pages, "out").count(), sinks.page_docx(lines.select("page_id", "text")).count())
open("p.png", "wb").write(images.png(4, 2, bytes(24)))
print(images.page_tiles(spark, "p.png").count(), readers.decode_images(spark, "p.png").first().width)
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    repo = str(Path(__file__).parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, lines=LINES, pages=PAGES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.split() == ["4", "1", "1", "4"], done.stderr[-3000:]
