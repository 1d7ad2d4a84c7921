"""The way from pixels to text: bands, tiles, image files, model plug-ins, options of collections."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import bands as B
from vellum.operators import cascade as C
from vellum.operators import flow
from vellum.operators import models as M
from vellum.plans import flow_queries as Q
from vellum.plans import views as V
from vellum.sources import images

PAGE = "page_id bigint, width int, height int, rgb binary"


def page(rng, width=120, height=160):
    """Dark stripes of random height and place on light ground, some faint, some touching the ends."""
    ink = np.zeros((height, width), bool)
    y = int(rng.integers(0, 6))
    while y < height:
        n = int(rng.integers(1, 24))
        left, right = sorted(rng.integers(0, width, 2))
        ink[y : y + n, left:right] = rng.random((len(ink[y : y + n]), right - left)) < rng.choice([0.05, 0.4, 0.9])
        y += n + int(rng.integers(1, 6))
    return np.repeat(np.where(ink, 20, 240).astype(np.uint8)[:, :, None], 3, axis=2).tobytes()


def plain(rgb, width, height, threshold=220):
    """Bands by looking at every pixel of the rules."""
    ink = np.frombuffer(rgb, np.uint8).reshape(height, width, 3).astype(int).sum(axis=2) < 3 * threshold
    rows = [y for y in range(height) if ink[y].sum() >= max(8, width // 80)]
    islands = []
    for y in rows:
        if islands and y - islands[-1][1] <= 3:
            islands[-1][1] = y
        else:
            islands.append([y, y])
    out = []
    for a, last in islands:
        z = height if height - 1 - last <= 2 else last + 1
        if z > a + 6:
            counts = ink[a:z].sum(axis=0)
            good = [x for x in range(width) if counts[x] >= max(1, (z - a) // 8, -(-counts.max() * 15 // 100))]
            x0 = max(good[0] - 2, 0) if good else 0
            x1 = min(good[-1] + 3, width) if good else width
            out.append((x0, max(a - 1, 0), max(x1, x0 + 1), min(z + 1, height)))
    return out


def found(df):
    return {(r.page_id, r.span): (r.x0, r.y0, r.x1, r.y1) for r in df.collect()}


def test_bands_of_random_pages_and_of_their_tiles(spark):
    rng = np.random.default_rng(1)
    pages = [(i, 120, 160, page(rng)) for i in range(60)]
    wanted = {(i, n): b for i, w, h, rgb in pages for n, b in enumerate(plain(rgb, w, h))}
    assert len(wanted) > 150 and found(B.page_bands(spark.createDataFrame(pages, PAGE))) == wanted
    tiles = []
    for i, w, h, rgb in pages:
        cuts = [0, *sorted(set(rng.integers(1, h, 4).tolist())), h]
        tiles += [(i, w, h, a, rgb[3 * w * a : 3 * w * z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    tiled = spark.createDataFrame(tiles, "page_id bigint, width int, height int, top int, rgb binary").repartition(5)
    assert found(B.tile_bands(tiled)) == wanted
    with pytest.raises(Exception, match="leave or repeat scan lines|end at scan line"):
        B.tile_bands(tiled.where("page_id <> 7 or top > 0")).collect()


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, 0, 0, b""), (2, 4, 4, None), (3, 5, 2, b"\xff" * 30), (4, None, 3, b"x")], PAGE)
    assert B.page_bands(pages).count() == 0 and B.page_ink(pages).count() == 2
    with pytest.raises(Exception, match="does not fit the size"):
        B.page_bands(spark.createDataFrame([(1, 2, 2, b"\x00" * 6)], PAGE)).collect()
    assert not spark.createDataFrame(pages.collect(), PAGE).transform(B.page_bands)._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("kind", [images.NONE, images.SUB, images.UP])
def test_image_files_and_tiles(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    pages = {f"p{i}": page(rng, 90, 131) for i in range(4)}
    for name, rgb in pages.items():
        (tmp_path / f"{name}.png").write_bytes(images.png(90, 131, rgb, kind))
    (tmp_path / "q.ppm").write_bytes(b"P6\n# note\n90 131\n255\n" + pages["p0"])
    (tmp_path / "r.PGM").write_bytes(b"P5 2 2 255\n" + bytes([1, 2, 3, 4]))
    (tmp_path / "other.txt").write_text("no image")
    whole = images.page_tiles(spark, str(tmp_path)).collect()
    read = {r.path.rsplit("/", 1)[1]: bytes(r.rgb) for r in whole}
    assert read == {**{f"{k}.png": v for k, v in pages.items()}, "q.ppm": pages["p0"], "r.PGM": bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4])}
    small = images.page_tiles(spark, str(tmp_path), tileBytes=90 * 3 * 33, partitionBytes=20_000).where("width = 90")
    assert small.rdd.getNumPartitions() > 1 and small.count() == 5 * 4
    keyed = lambda df: df.withColumn("page_id", F.hash("path").cast("long"))
    one = found(B.tile_bands(keyed(images.page_tiles(spark, str(tmp_path)).where("width = 90"))))
    assert one and one == found(B.tile_bands(keyed(small))) == found(B.page_bands(keyed(images.page_tiles(spark, f"{tmp_path}/").where("width = 90"))))
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a PNG"):
        images.page_tiles(spark, str(tmp_path)).collect()


def test_from_image_files_to_text(spark, sf, tmp_path):
    drawn = V.v_packed(spark, sf).collect()
    for r in drawn:
        (tmp_path / f"p{r.page_id}.png").write_bytes(images.png(r.width, r.height, bytes(r.rgb), images.UP))
    read = images.whole_pages(images.page_tiles(spark, str(tmp_path), tileBytes=240 * 3 * 50)).withColumn("collection", F.lit("a"))
    number = F.regexp_extract("path", r"p(\d+)\.png$", 1).cast("long")
    texts = flow.recognize_pages(read, None, {"a": {}}, Q.MODELS).join(read.select("page_id", number.alias("n")), "page_id")
    wanted = flow.recognize_pages(V.v_packed(spark, sf).withColumn("collection", F.lit("a")), None, {"a": {}}, Q.MODELS)
    found = {r.n: r.text for r in texts.collect()}
    assert found and found == {r.page_id: r.text for r in wanted.collect()}


def test_filters_that_need_each_byte():
    above, line = np.array([10, 20, 30, 40, 50, 60], np.uint8), np.array([1, 2, 3, 250, 5, 6], np.uint8)
    assert images._unfiltered(images.AVERAGE, line, above, 3).tolist() == [6, 12, 18, 17, 36, 45]
    assert images._unfiltered(images.PAETH, line, above, 3).tolist() == [11, 22, 33, 34, 55, 66]


def echo(short=0, name="echo"):
    """A reader that counts what its session was shown, and names each line; ``short`` results are missing."""

    class Echo:
        key = name

        def open(self):
            return {"shown": 0}

        def run(self, session, rows):
            session["shown"] += rows.num_rows
            return [(f"line {i}", 0.5) for i in rows["det_id"].to_pylist()[short:]]

        def close(self, session):
            session["closed"] = True

    return Echo()


def test_recognisers_by_batches(spark):
    lines = spark.range(25).selectExpr("id as page_id", "cast(id as int) as det_id", "'keep' as other").repartition(2)
    read = M.recognizer(echo(), ("det_id",), batch_bytes=64)(lines).collect()
    assert {(r.det_id, r.text, r.other) for r in read} == {(i, f"line {i}", "keep") for i in range(25)}
    with pytest.raises(Exception, match="results for"):
        M.recognizer(echo(1), ("det_id",))(lines).collect()


def test_sessions_are_kept_and_closed():
    M._sessions.clear()
    first = M.session_of(echo(name="n1"), 2)
    assert M.session_of(echo(name="n1"), 2) is first
    second = M.session_of(echo(name="n2"), 2)
    M.session_of(echo(name="n1"), 2)
    M.session_of(echo(name="n3"), 2)
    assert second["closed"] and "closed" not in first and list(M._sessions) == ["n1", "n3"]
    M._sessions.clear()


def test_detectors(spark, sf):
    pages = V.v_packed(spark, sf)
    boxes = M.detect(pages, M.BandDetector(), batch_bytes=1)
    lines = {(r.page_id, r.det_id): (r.x0, r.y0, r.x1, r.y1) for r in boxes.collect()}
    assert lines == found(B.page_bands(pages)) and lines
    class Shapes(M.BandDetector):
        def run(self, session, rows):
            return [([1, 2], [[0, 0, 1, 1]], [0.5, 0.5], None)] * rows.num_rows

    with pytest.raises(Exception, match="differ in number"):
        M.detect(pages, Shapes()).collect()


def test_each_model_is_shown_a_line_once(spark, tmp_path):
    def noted(name, text):
        @F.udf("string")
        def note(i):
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write(f"{i}\n")
            return text

        return lambda df: df.withColumns({"text": note.asNondeterministic()("det_id"), "mean_confidence": F.lit(0.9)})

    shown = lambda name: sorted(map(int, (tmp_path / name).read_text().split())) if (tmp_path / name).exists() else []
    box = {3.0: (0, 0, 100, 20), 2.0: (0, 0, 150, 10), 100.0: (0, 0, 400, 10)}
    rows = spark.createDataFrame([(1, i, *box[c], c) for i, c in enumerate((3.0, 2.0, 100.0))], "page_id bigint, det_id int, x0 int, y0 int, x1 int, y1 int, char_count double")
    read = C.cascade(rows, noted("small", "x" * 30), noted("middle", "y" * 10), noted("large", "z"))
    assert {r.det_id: r.text[0] for r in read.collect()} == {0: "y", 1: "y", 2: "z"}
    assert (shown("small"), shown("middle"), shown("large")) == ([0], [0, 1], [2])
    base = rows.withColumns({"text": F.lit("base"), "mean_confidence": F.lit(0.1)})
    listed = C.candidates(base, noted("s", "small"), noted("m", "middle"), noted("l", "large")).collect()
    assert {r.det_id: [c.text for c in r.candidates] for r in listed} == {0: ["base", "large", "small", "large"], 1: ["base", "large", "middle", "large"], 2: ["base", "large", "large"]}
    assert (shown("s"), shown("m"), shown("l")) == ([0], [1], [0, 1, 2])
    without = C.candidates(base, None, None, noted("w", "large")).collect()
    assert all(len(r.candidates) == 3 for r in without)


def test_options(spark, sf):
    pages = V.v_packed(spark, sf).withColumn("collection", F.lit("a"))
    text = lambda given: {r.page_id: r.text for r in flow.recognize_pages(pages, None, {"a": given}, Q.MODELS, Q.RULES).collect()}
    plain_, dictionary = text({"structure_rules": False}), text({"structure_rules": False, "post_dict": "names"})
    assert plain_ and all(dictionary[i] == t.replace("開示", "公開").replace("7", "七") for i, t in plain_.items())
    assert text({"min_line_confidence": 2.0}) == {} and text({"binarize_threshold": 0}) == {}
    for bad in ({"unknown": 1}, {"post_dict": "none"}, {"rule_pack": "none"}):
        with pytest.raises(ValueError):
            text(bad)
    with pytest.raises(Exception, match="no options for collection b"):
        flow.recognize_pages(pages.withColumn("collection", F.lit("b")), None, {"a": {}}, Q.MODELS).collect()
    assert flow.recognize_pages(pages.limit(0), None, {"a": {}}, Q.MODELS).count() == 0


def test_detections_come_before_bands(spark, sf):
    pages = V.v_packed(spark, sf).withColumn("collection", F.lit("a"))
    raw = pages.select("page_id", F.lit(0).alias("det_id"), F.lit(2).alias("label"), F.lit(0.9).alias("score"), *[F.lit(v).alias(c) for c, v in (("x0", 5.0), ("y0", 6.0), ("x1", 50.0), ("y1", 20.0))], F.lit(3.0).alias("char_count")).where("page_id % 2 = 0")
    lines = flow.recognize_lines(pages, raw, {"a": {"min_line_confidence": 0.0}}, Q.MODELS).collect()
    boxes = {}
    for r in lines:
        boxes.setdefault(r.page_id, []).append((r.x0, r.y0, r.x1, r.y1))
    assert all(boxes[i] == [(5, 6, 50, 20)] for i in boxes if i % 2 == 0) and any(len(b) > 1 for i, b in boxes.items() if i % 2)
    off = flow.recognize_lines(pages, raw, {"a": {"use_detection": False, "min_line_confidence": 0.0}}, Q.MODELS)
    assert off.where("page_id % 2 = 0 and x0 = 5 and y0 = 6").count() == 0


def test_single_lines_and_mock_pages(spark):
    lines = spark.createDataFrame([("a", 0, 0, 60, 9)], "id string, x0 int, y0 int, x1 int, y1 int")
    r = flow.recognize_line_images(lines, Q.reader(100)).first()
    assert r.id == "a" and r.text == r.text.strip()
    pages = spark.createDataFrame([(1, 100, 60)], "page_id bigint, width int, height int")
    rows = flow.mock_pages(pages, F.lit(3), F.lit(1.5), "words").orderBy("line_idx").collect()
    assert [(r.text, r.confidence, r.is_vertical) for r in rows] == [("words", 1.0, False)] * 3 and rows[0].y0 < rows[1].y0
