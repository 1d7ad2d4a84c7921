"""Queries over detections, recognised lines, pixels, logits and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import decode as D
from vellum.functions import geometry as G
from vellum.functions import pixels as X
from vellum.functions import text as T
from vellum.operators import bands as B
from vellum.operators import cascade as C
from vellum.operators import evaluate as E
from vellum.operators import flow
from vellum.operators import layout as L
from vellum.operators import models as M
from vellum.operators import page_rules as R
from vellum.plans import text_queries as TQ
from vellum.plans import views as V
from vellum.plans.views import HEIGHT, WIDTH, stub, stub_sql, with_views
from vellum.sources import readers, sinks

BOXES = ["page_id", "det_id", "class_name", "x0", "y0", "x1", "y1"]
CHARSET = "abcdefg"
SMALL, MIDDLE, LARGE = stub(30), stub(50), stub(100)


def _found(df: DataFrame) -> DataFrame:
    return df.select("page_id", "det_id", "text", F.round("mean_confidence", 6).alias("mean_confidence"))


def det_build(s, d):
    return L.build_detections(V.v_raw(s, d), 0.25, F.lit(WIDTH / 800), F.lit(HEIGHT / 800)).select(*BOXES, "score", "char_count")


def det_clamp_valid(s, d):
    return L.clamp_valid(V.v_detections(s, d), F.lit(WIDTH), F.lit(HEIGHT)).select(*BOXES)


def char_bucket(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return V.v_detections(s, d).select("page_id", "det_id", G.char_count(w, h).alias("n"), G.char_bucket(w, h).alias("bucket"), G.near_bucket(F.col("char_count")).alias("near"))


def bucket_histogram(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return V.v_detections(s, d).groupBy(G.char_bucket(w, h).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def line_json_ids(s, d):
    lines = L.reading_order(V.v_crops(s, d))
    return lines.select("page_id", "det_id", "line_idx", F.to_json(G.corners()).alias("box"), F.greatest(F.col("x1") - F.col("x0"), F.lit(1)).alias("w"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1)).alias("h"))


def _sizes(s, d):
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("page_id"), (F.col("c_custkey") * 37 % 900).alias("width"), (F.col("c_custkey") * 53 % 700).alias("height"), (F.col("c_custkey") % 60).alias("n"), (F.col("c_acctbal") / 1000).alias("c"))


def mock_layout(s, d):
    pages = _sizes(s, d)
    return L.mock_detections(pages, G.normalized_count(F.col("n"), F.col("height")), F.col("c")).select("page_id", "det_id", "confidence", *G.BOX)


def fallback_pages(s, d):
    found = V.v_detections(s, d).where("page_id % 3 <> 0 or class_name = 'block_fig'")
    pages = V.v_pages(s, d)
    bands = L.mock_detections(pages, F.lit(3), F.lit(1.0)).select("page_id", "det_id", "class_name", "confidence", *G.BOX, "char_count")
    return L.with_fallback(found, pages, bands).select(*BOXES)


def input_union(s, d):
    kind = lambda n: F.element_at(F.array(*map(F.lit, (".png", ".TIF", ".gif", ""))), (F.col(n) % 4 + 1).cast("int"))
    listed = V.table(s, d, "pages").select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), kind("page_id")).alias("path"))
    single = V.table(s, d, "customer").select(F.concat(F.lit("one/"), F.col("c_custkey").cast("string"), kind("c_custkey")).alias("path"))
    return readers.input_union(listed, single)


def supported_ext(s, d):
    path = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, (".png", ".TIF", ".gif", "", ".Jp2"))), (F.col("page_id") % 5 + 1).cast("int")))
    return V.table(s, d, "pages").select("page_id", readers.is_supported_image(path).alias("ok"))


def page_totals(s, d):
    return E.page_totals(V.v_crops(s, d)).select("pages", "lines")


def output_stems(s, d):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("s"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, F.lit(""))
    return V.table(s, d, "pages").select("page_id", sinks.output_stem(given, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, (".png", "/", "/.x", ""))), (F.col("page_id") % 4 + 1).cast("int")))).alias("stem"))


def fallback_bands(s, d):
    return L.bands_as_detections(B.page_bands(V.v_packed(s, d))).select(*BOXES, "char_count")


def detect_bands(s, d):
    """The detector plug-in's rows, as lines of the page."""
    raw = M.detect(V.v_packed(s, d), M.BandDetector())
    return L.lines_only(L.build_detections(raw, 0.25, F.lit(1.0), F.lit(1.0))).select(*BOXES, "score", "char_count")


def decode_confidence(s, d):
    r = D.decode_with_confidence(F.col("logits"), CHARSET)
    return V.v_logits(s, d).select("line_id", r.alias("r")).select("line_id", "r.text", F.round("r.mean_confidence", 6).alias("mean_confidence"))


def cascade_closure(s, d):
    return _found(C.cascade(V.v_crops(s, d), SMALL, MIDDLE, LARGE, bucket=F.col("char_count")))


def cascade_pool(s, d):
    return _found(C.cascade(V.v_crops(s, d), SMALL, MIDDLE, LARGE))


def cascade_cli(s, d):
    return _found(C.cascade(V.v_crops(s, d), None, MIDDLE, LARGE, 20, 40))


def cascade_no_model(s, d):
    return _found(C.cascade_any_bucket(V.v_crops(s, d), SMALL, MIDDLE, LARGE))


def split_long(s, d):
    return _found(C.split_long(LARGE(V.v_crops(s, d)), LARGE, 60))


def rerank(s, d):
    df = V.v_crops(s, d)
    for k in (30, 50, 100):
        df = stub(k)(df).withColumn(f"r{k}", F.struct("text", "mean_confidence")).drop("text", "mean_confidence")
    best = C.rerank(F.array("r50", "r100", F.when(F.col("is_vertical"), F.col("r30"))))
    return df.select("page_id", "det_id", best.alias("b")).select("page_id", "det_id", "b.text", F.round(F.col("b.score") + 1e-9, 6).alias("score"))


def _recognized(s, d):
    found = C.split_long(C.cascade(V.v_crops(s, d), SMALL, MIDDLE, LARGE), LARGE)
    return L.reading_order(C.keep_confident(found)).withColumn("confidence", F.col("mean_confidence"))


def run_page(s, d):
    lines = flow.detailed_lines(V.v_detections(s, d), F.lit(WIDTH), F.lit(HEIGHT), flow.Models(LARGE, MIDDLE, SMALL))
    return lines.select("page_id", "line_idx", "text", F.round("confidence", 6).alias("confidence"))


def recognize_page(s, d):
    """Crops, cascade, split, confidence filter, reading order, structural rules, page text."""
    return R.page_text(R.structural_rules(_recognized(s, d).select("page_id", "line_idx", "text")))


def mock_page(s, d):
    return flow.mock_pages(_sizes(s, d), F.col("n"), F.col("c"), "mock100", True).select("page_id", "line_idx", "text", "confidence", "is_vertical")


def page_batch(s, d):
    lines = flow.batch_lines(V.v_detections(s, d).where("confidence > 0.3"), F.lit(WIDTH), F.lit(HEIGHT), LARGE)
    return lines.select("page_id", "line_idx", "text", F.round("mean_confidence", 6).alias("mean_confidence"))


def _named(s, d):
    return V.v_pages(s, d).select("page_id", "width", "height", F.concat(F.lit("in/"), "page_id").alias("path"), F.concat(F.lit("p<"), "page_id").alias("name"))


def out_json(s, d):
    return sinks.page_json(_recognized(s, d), _named(s, d))


def out_xml(s, d):
    return sinks.page_xml(_recognized(s, d), _named(s, d))


def out_text(s, d):
    return R.page_text(_recognized(s, d))


def _metrics(s, d, level="strict"):
    return E.file_metrics(V.v_truth(s, d), V.v_pred(s, d), level)


def cer_wer(s, d):
    return E.system_metrics(_metrics(s, d)).select("system", "matched", "char_errors", "char_total", F.round("cer", 9).alias("cer"))


def systems_ranked(s, d):
    missing = E.missing_files(V.v_truth(s, d), V.v_pred(s, d))
    return E.ranked(E.with_missing(E.system_metrics(_metrics(s, d)), missing)).select("place", "system", "matched", "missing", F.round("cer", 9).alias("cer"))


def cer_delta(s, d):
    return E.deltas(E.system_metrics(_metrics(s, d)), "lower").select("system", F.round("cer", 9).alias("cer"), F.round("delta_cer", 9).alias("delta_cer"))


def evaluation_cube(s, d):
    """Three normalisation levels, all systems and their total in one pass, with differences from one of them."""
    out = E.cube(V.v_truth(s, d), V.v_pred(s, d), baseline="lower")
    return out.select("level", "system", "is_total", "matched", "missing", "char_errors", "char_total", "word_errors", "word_total", *[F.round(c, 9).alias(c) for c in ("cer", "wer", "delta_cer", "delta_wer")])


def order_restored(s, d):
    """Lines of each page as read in order, a third of them twice, put back by the place of the first equal box."""
    lines = V.v_crops(s, d)
    again = lines.where("det_id % 3 = 0").withColumn("det_id", F.col("det_id") + 1000)
    both = lines.unionByName(again)
    return L.restore_order(both, L.reading_order(both)).select("page_id", "det_id", "place")


def timing_summary(s, d):
    out = E.timing_summary(V.table(s, d, "events").select(F.col("value").alias("wall_seconds")))
    return out.select("files", F.round("total_seconds", 3).alias("total_seconds"), F.round("mean_seconds", 6).alias("mean_seconds"))


def crop_pixels(s, d):
    from vellum.session import ship

    ship(s)
    left = (F.col("page_id") % 40 + 10).cast("int")
    cut = X.crop_udf()(F.col("rgb"), F.col("width"), F.col("height"), left, F.lit(5), F.lit(60), F.lit(25))
    n = F.expr("octet_length(cut) div 3").cast("int")
    byte = lambda i, c: F.conv(F.hex(F.substring(F.col("cut"), i * 3 + c + 1, F.lit(1))), 16, 10).cast("long")
    # each sum weighs a pixel with its place in the crop
    total = lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte(i, c) * (i % 13)), F.lit(0).cast("long"), lambda a, v: a + v)
    return V.v_packed(s, d).select("page_id", cut.alias("cut")).select("page_id", n.cast("long").alias("n"), *[total(c).alias(k) for c, k in enumerate("rgb")])


def _mean(values):
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values), 4)


def _tensor(kind, w, h, box):
    def run(s, d):
        from vellum.session import ship

        ship(s)
        pixels = X.tensor_udf(kind, w, h)(F.col("rgb"), F.col("width"), F.col("height"), *map(F.lit, box))
        return V.v_packed(s, d).select("page_id", pixels.alias("t")).select("page_id", F.size("t").cast("long").alias("n"), _mean(F.transform("t", lambda v: v.cast("double"))).alias("mean"), _mean(F.transform("t", lambda v, i: v.cast("double") * (i % 11))).alias("weighted"))

    return run


QUERIES = {
    "det_build": det_build,
    "det_clamp_valid": det_clamp_valid,
    "det_lines_only": lambda s, d: L.lines_only(V.v_detections(s, d)).select(*BOXES),
    "crop_boxes_cli": lambda s, d: V.v_crops(s, d).select(*BOXES, "is_vertical"),
    "crop_boxes_batch": lambda s, d: L.crop_boxes_batch(V.v_detections(s, d), F.lit(WIDTH), F.lit(HEIGHT)).select(*BOXES, "is_vertical"),
    "char_bucket": char_bucket,
    "bucket_histogram": bucket_histogram,
    "reading_order": lambda s, d: L.reading_order(V.v_crops(s, d)).select("page_id", "det_id", "line_idx"),
    "page_counts": lambda s, d: L.page_counts(V.v_detections(s, d)),
    "line_json_ids": line_json_ids,
    "mock_layout": mock_layout,
    "fallback_pages": fallback_pages,
    "input_union": input_union,
    "supported_ext": supported_ext,
    "row_ink": lambda s, d: B.page_ink(V.v_packed(s, d)),
    "line_spans": lambda s, d: B.page_spans(V.v_packed(s, d)),
    "line_bands": lambda s, d: B.page_bands(V.v_packed(s, d)),
    "detect_bands": detect_bands,
    "fallback_bands": fallback_bands,
    "argmax_decode": lambda s, d: V.v_logits(s, d).select("line_id", D.decode_logits(F.col("logits"), CHARSET).alias("text")),
    "decode_confidence": decode_confidence,
    "cascade_closure": cascade_closure,
    "cascade_pool": cascade_pool,
    "cascade_cli": cascade_cli,
    "cascade_no_model": cascade_no_model,
    "split_long": split_long,
    "rerank": rerank,
    "run_page": run_page,
    "recognize_page": recognize_page,
    "mock_page": mock_page,
    "page_batch": page_batch,
    "out_json": out_json,
    "out_xml": out_xml,
    "out_text": out_text,
    "char_errors": lambda s, d: _metrics(s, d).select("system", "relpath", "char_errors", "char_total", F.round("cer", 9).alias("cer")),
    "word_errors": lambda s, d: _metrics(s, d, "basic").select("system", "relpath", "word_errors", "word_total", F.round("wer", 9).alias("wer")),
    "cer_wer": cer_wer,
    "cer_delta": cer_delta,
    "systems_ranked": systems_ranked,
    "page_totals": page_totals,
    "output_stems": output_stems,
    "missing_files": lambda s, d: E.missing_files(V.v_truth(s, d), V.v_pred(s, d)),
    "missing_top30": lambda s, d: E.top_missing(E.missing_files(V.v_truth(s, d), V.v_pred(s, d))),
    "evaluation_cube": evaluation_cube,
    "order_restored": order_restored,
    "timing_summary": timing_summary,
    "fixture_stem": lambda s, d: V.table(s, d, "pages").select("page_id", T.url_stem(F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", r"^(\w+://[^/]*)", 1), F.lit("/law/129AC0!x?foo=1#a"))).otherwise(F.col("url"))).alias("stem")),
    "crop_pixels": crop_pixels,
    "prep_recognizer": _tensor("recognizer", 64, 16, (10, 5, 130, 45)),
    "prep_detector": _tensor("detector", 32, 32, (0, 0, 240, 140)),
}

_B = "page_id, det_id, class_name, x0, y0, x1, y1"
_N = "greatest(1, floor((x1 - x0) / greatest(y1 - y0, 1)::DOUBLE * 2.5 + 0.5))::INT"
_BUCKET = f"CASE WHEN {_N} <= 25 THEN 3.0 WHEN {_N} <= 45 THEN 2.0 ELSE 100.0 END::DOUBLE"
_NEAR = "CASE WHEN abs(char_count - 3.0) < 0.2 THEN 3.0 WHEN abs(char_count - 2.0) < 0.2 THEN 2.0 ELSE 100.0 END::DOUBLE"
_INSIDE = f"starts_with(class_name, 'line_') AND x0 >= 0 AND y0 >= 0 AND x1 > x0 AND y1 > y0 AND x1 <= {WIDTH} AND y1 <= {HEIGHT}"
_BATCH = f"batch AS (SELECT *, y1 - y0 > x1 - x0 AS is_vertical FROM detections WHERE {_INSIDE})"
_ORDER = "row_number() OVER (PARTITION BY page_id ORDER BY is_vertical DESC, CASE WHEN is_vertical THEN -x0 ELSE y0 END, CASE WHEN is_vertical THEN y0 ELSE x0 END, det_id) - 1"
_SIZES = "sizes AS (SELECT c_custkey AS page_id, c_custkey * 37 % 900 AS width, c_custkey * 53 % 700 AS height, least(greatest(c_custkey % 60, 1), greatest(c_custkey * 53 % 700, 1)) AS want, c_acctbal / 1000 AS c FROM customer)"


def _mock(source: str, out: str) -> str:
    return f"""{out} AS (SELECT page_id, i AS det_id, least(greatest(c, 0), 1.0) AS confidence, x0::INT AS x0, (top + (i * inr) // n)::INT AS y0, x1::INT AS x1,
      (CASE WHEN top + ((i + 1) * inr) // n <= top + (i * inr) // n THEN least(top + (i * inr) // n + 1, greatest(height, 1)) ELSE top + ((i + 1) * inr) // n END)::INT AS y1 FROM (
      SELECT *, unnest(range(n)) AS i FROM (SELECT *, least(want, inr) AS n FROM (SELECT *, greatest(greatest(greatest(height - my, 0), top + 1) - top, 1) AS inr FROM (
      SELECT *, CASE WHEN width > 2 * mx THEN mx ELSE 0 END AS x0, CASE WHEN width > 2 * mx THEN width - mx ELSE greatest(width, 1) END AS x1, least(my, greatest(height - 1, 0)) AS top FROM (
      SELECT *, greatest(width // 50, 1) AS mx, greatest(height // 50, 1) AS my FROM {source})))))) """


def _cascade(source: str, out: str, kind: str, first: int, second: int, small: int, middle: int, large: int) -> str:
    (a, ac), (b, bc), (c, cc) = stub_sql(small), stub_sql(middle), stub_sql(large)
    pick = lambda x, y, z: f"CASE WHEN kind = 3.0 THEN CASE WHEN length({a}) < {first} THEN {x} WHEN length({b}) < {second} THEN {y} ELSE {z} END WHEN kind = 2.0 THEN CASE WHEN length({b}) < {second} THEN {y} ELSE {z} END ELSE {z} END"
    return f"{out} AS (SELECT * EXCLUDE (kind), {pick(a, b, c)} AS text, {pick(ac, bc, cc)} AS mean_confidence FROM (SELECT *, {kind} AS kind FROM {source}))"


def _split(source: str, out: str, threshold: int) -> str:
    mid = "(x0 + (x1 - x0) // 2)"
    (lt, lc), (rt, rc) = stub_sql(100, x0="x0", x1=mid), stub_sql(100, x0=mid, x1="x1")
    return f"""{out} AS (SELECT * EXCLUDE (lt, lc, rt, rc, text, mean_confidence), CASE WHEN hit THEN lt || rt ELSE text END AS text, CASE WHEN hit THEN (lc * length(lt) + rc * length(rt)) / (length(lt) + length(rt)) ELSE mean_confidence END AS mean_confidence
      FROM (SELECT *, length(text) >= {threshold} AND x1 - x0 >= 4 * (y1 - y0) AND (x1 - x0) // 2 > 0 AND length(lt) + length(rt) > 0 AS hit FROM (SELECT *, {lt} AS lt, {lc} AS lc, {rt} AS rt, {rc} AS rc FROM {source})))"""


_FOUND = "SELECT page_id, det_id, text, round(mean_confidence, 6) AS mean_confidence FROM "
_RECOGNIZED = with_views("crops", more=_cascade("crops", "f1", _NEAR, 25, 45, 30, 50, 100) + ", " + _split("f1", "f2", 80) + rf", done AS (SELECT *, {_ORDER} AS line_idx FROM f2 WHERE mean_confidence >= 0.30 AND regexp_matches(text, '[^\s]'))")
_PIXELS = with_views("pixels", more="""ink AS (SELECT page_id, y, count_if(r + g + b < 660) AS ink FROM pixels GROUP BY page_id, y),
  isl AS (SELECT page_id, y, sum(new) OVER (PARTITION BY page_id ORDER BY y) AS island FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) <= 3 THEN 0 ELSE 1 END AS new FROM ink WHERE ink >= greatest(8, 240 // 80))),
  spans AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0) - 1 AS span, y0, y1 FROM (SELECT page_id, min(y) AS y0, CASE WHEN 139 - max(y) <= 2 THEN 140 ELSE max(y) + 1 END AS y1 FROM isl GROUP BY page_id, island) WHERE y1 > y0 + 6),
  cols AS (SELECT *, max(ink) OVER (PARTITION BY page_id, span) AS most FROM (SELECT s.page_id, span, y0, y1, x, count(*) AS ink FROM spans s JOIN pixels p ON s.page_id = p.page_id AND y >= y0 AND y < y1 WHERE r + g + b < 660 GROUP BY s.page_id, span, y0, y1, x)),
  bounds AS (SELECT page_id, span, min(x) AS l, max(x) AS r FROM cols WHERE ink >= greatest(1, (y1 - y0) // 8, ceil(most * 0.15::DOUBLE)) GROUP BY page_id, span),
  bands AS (SELECT s.page_id, s.span, coalesce(greatest(l - 2, 0), 0)::INT AS x0, greatest(y0 - 1, 0)::INT AS y0, greatest(coalesce(least(r + 3, 240), 240), coalesce(greatest(l - 2, 0), 0) + 1)::INT AS x1, least(y1 + 1, 140)::INT AS y1 FROM spans s LEFT JOIN bounds b ON s.page_id = b.page_id AND s.span = b.span)""")  # fmt: skip
#: The tensors hold single precision, so the twins work in FLOAT step by step; only the sums are in double precision.
_MEANS = " SELECT page_id, count(*) AS n, round(avg(v::DOUBLE), 4) AS mean, round(avg(v::DOUBLE * (place % 11)), 4) AS weighted FROM t GROUP BY page_id"
_CORNERS = ", ".join(f"max(CASE WHEN n = {n} THEN {c} END)::FLOAT AS {c}{n}" for c in "rgb" for n in range(4))
_MIX = lambda c: f"(({c}0 * (1::FLOAT - wx) + {c}1 * wx) * (1::FLOAT - wy) + ({c}2 * (1::FLOAT - wx) + {c}3 * wx) * wy) / 127.5::FLOAT - 1::FLOAT"
_RECOGNIZER = with_views("pixels", more=f"""spots AS (SELECT i, j, floor(py)::INT AS ya, floor(px)::INT AS xa, py - floor(py) AS wy, px - floor(px) AS wx FROM (
    SELECT i, j, least(greatest((i::FLOAT + 0.5::FLOAT) * 2.5::FLOAT - 0.5::FLOAT, 0::FLOAT), 39::FLOAT) AS py, least(greatest((j::FLOAT + 0.5::FLOAT) * 1.875::FLOAT - 0.5::FLOAT, 0::FLOAT), 119::FLOAT) AS px FROM range(16) a(i), range(64) b(j))),
  corners AS (SELECT *, 2 * dy + dx AS n, 5 + least(ya + dy, 39) AS y, 10 + least(xa + dx, 119) AS x FROM spots, range(2) a(dy), range(2) b(dx)),
  mixed AS (SELECT page_id, i, j, wy, wx, {_CORNERS} FROM corners JOIN pixels USING (y, x) GROUP BY page_id, i, j, wy, wx),
  t AS (SELECT page_id, k * 1024 + i * 64 + j AS place, CASE k WHEN 0 THEN {_MIX('b')} WHEN 1 THEN {_MIX('g')} ELSE {_MIX('r')} END AS v FROM mixed, range(3) z(k))""") + _MEANS  # fmt: skip
_DETECTOR = with_views("pixels", more="""spots AS (SELECT s_suppkey::BIGINT AS page_id, i, j, i * 240 // 32 AS y, j * 240 // 32 AS x FROM supplier, range(32) a(i), range(32) b(j)),
  t AS (SELECT page_id, c * 1024 + i * 32 + j AS place, (coalesce(CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END, 0)::FLOAT / 255::FLOAT - m) / d AS v FROM spots LEFT JOIN pixels USING (page_id, y, x), (VALUES (0, 0.485::FLOAT, 0.229::FLOAT), (1, 0.456::FLOAT, 0.224::FLOAT), (2, 0.406::FLOAT, 0.225::FLOAT)) k(c, m, d))""") + _MEANS
_TOKENS = "am AS (SELECT line_id, t, arg_max(c, (v, -c)) AS i, 1.0 / sum(exp(v - m)) AS p FROM (SELECT *, max(v) OVER (PARTITION BY line_id, t) AS m FROM logits) GROUP BY line_id, t)"
#: DuckDB counts bytes, so in its twins the letters of these tables that take two become control characters that occur nowhere.
LETTERS = "ÄÇÈÉÊÑÖÜßäçèéêíñóöü"


def narrow(x: str) -> str:
    return f"translate({x}, '{LETTERS}', {' || '.join(f'chr({i})' for i in (*range(1, 9), *range(14, 14 + len(LETTERS) - 8)))})"


_METRICS = with_views("pred", more=f"fm AS (SELECT system, relpath, levenshtein({narrow('a')}, {narrow('b')}) AS char_errors, length(a) AS char_total FROM (SELECT p.system, p.relpath, {TQ.folded('t.text', 'strict')} AS a, {TQ.folded('p.text', 'strict')} AS b FROM truth t JOIN pred p ON t.relpath = p.relpath)), sm AS (SELECT system, count(*) AS matched, sum(char_errors) AS char_errors, sum(char_total) AS char_total, sum(char_errors) / sum(char_total)::DOUBLE AS cer FROM fm GROUP BY system)")
_MISSING = "missing AS (SELECT system, relpath FROM (SELECT s.system, t.relpath FROM (SELECT DISTINCT system FROM pred) s, truth t) w ANTI JOIN pred p USING (system, relpath))"
_SUFFIX = "lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'tiff', 'tif', 'jp2', 'bmp')"
_XML = """'<?xml version="1.0" encoding="utf-8" standalone="yes"?>' || chr(10) || '<OCRDATASET xmlns="">' || chr(10) || '  <PAGE IMAGENAME="p<' || o_orderkey || '" WIDTH="1000" HEIGHT="1200">' || chr(10) || '    <TEXTBLOCK>' || chr(10) || coalesce(body, '') || '    </TEXTBLOCK>' || chr(10) || '  </PAGE>' || chr(10) || '</OCRDATASET>' || chr(10)"""
_LINE = """format('      <LINE TYPE="line_main" X="{}" Y="{}" WIDTH="{}" HEIGHT="{}" CONF="{:.3f}" STRING="{}" ORIENT="{}"></LINE>', x0, y0, greatest(x1 - x0, 1), greatest(y1 - y0, 1), mean_confidence, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), CASE WHEN is_vertical THEN 'vertical' ELSE 'horizontal' END) || chr(10)"""


_ITEM = """'{"boundingBox":[[' || x0 || ',' || y0 || '],[' || x0 || ',' || y1 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || ']],"id":' || line_idx || ',"isVertical":"' || is_vertical || '","text":"' || text || '","isTextline":"true","confidence":' || mean_confidence || '}'"""
#: Each distinct word of a pair becomes one of the 127 ASCII characters: no pair of these tables has as many.
_WORDS = with_views("pred", more=rf"""ws AS (SELECT p.system, p.relpath, list_filter(string_split_regex({TQ.folded('t.text', 'basic')}, '\s+'), lambda w: w <> '') AS a, list_filter(string_split_regex({TQ.folded('p.text', 'basic')}, '\s+'), lambda w: w <> '') AS b FROM truth t JOIN pred p ON t.relpath = p.relpath),
  sp AS (SELECT system, relpath, len(a) AS n, array_to_string(list_transform(a, lambda w: chr(list_position(k, w)::INT)), '') AS x, array_to_string(list_transform(b, lambda w: chr(list_position(k, w)::INT)), '') AS y FROM (SELECT *, list_distinct(list_concat(a, b)) AS k FROM ws))""") + " SELECT system, relpath, levenshtein(x, y) AS word_errors, n AS word_total, round(CASE WHEN n > 0 THEN levenshtein(x, y) / n::DOUBLE WHEN levenshtein(x, y) > 0 THEN 1.0 ELSE 0.0 END, 9) AS wer FROM sp"


def _cube_sql() -> str:
    forms = ", ".join(f"{{'level': '{n}', 'a': {'t.text' if n == 'none' else TQ.folded('t.text', n)}, 'b': {'p.text' if n == 'none' else TQ.folded('p.text', n)}}}" for n in ("none", "basic", "strict"))
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("char_errors", "char_total", "word_errors", "word_total"))
    rate = lambda e, n: f"CASE WHEN {n} > 0 THEN {e} / {n}::DOUBLE ELSE 0.0 END"
    listed = lambda c: rf"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"
    more = f"""lv AS (SELECT system, unnest([{forms}], recursive := true) FROM truth t JOIN pred p ON t.relpath = p.relpath),
      ls AS (SELECT *, {listed('a')} AS la, {listed('b')} AS lb FROM lv),
      sp AS (SELECT *, array_to_string(list_transform(la, lambda w: chr(list_position(k, w)::INT)), '') AS x, array_to_string(list_transform(lb, lambda w: chr(list_position(k, w)::INT)), '') AS y FROM (SELECT *, list_distinct(list_concat(la, lb)) AS k FROM ls)),
      fm AS (SELECT level, system, levenshtein({narrow('a')}, {narrow('b')}) AS char_errors, length(a) AS char_total, levenshtein(x, y) AS word_errors, len(la) AS word_total FROM sp),
      sm AS (SELECT level, system, grouping(system) = 1 AS is_total, count(*) AS matched, {sums} FROM fm GROUP BY GROUPING SETS ((level, system), (level))),
      {_MISSING},
      ra AS (SELECT *, (SELECT count(*) FROM missing m WHERE is_total OR m.system = sm.system) AS missing, {rate('char_errors', 'char_total')} AS cer, {rate('word_errors', 'word_total')} AS wer FROM sm)"""
    delta = lambda c: f"round({c} - max(CASE WHEN system = 'lower' THEN {c} END) OVER (PARTITION BY level), 9) AS delta_{c}"
    return with_views("pred", more=more) + f" SELECT level, system, is_total, matched, missing, char_errors::BIGINT AS char_errors, char_total::BIGINT AS char_total, word_errors::BIGINT AS word_errors, word_total::BIGINT AS word_total, round(cer, 9) AS cer, round(wer, 9) AS wer, {delta('cer')}, {delta('wer')} FROM ra"


_RESTORED = with_views("crops", more=f"twice AS (SELECT * FROM crops UNION ALL SELECT * REPLACE (det_id + 1000 AS det_id) FROM crops WHERE det_id % 3 = 0), placed AS (SELECT *, {_ORDER} AS line_idx FROM twice)") + " SELECT page_id, det_id, min(line_idx) OVER (PARTITION BY page_id, x0, y0, x1, y1) AS place FROM placed"


def _rerank_sql() -> str:
    score = lambda t, c: f"(CASE WHEN length({t}) = 0 THEN -1.0 ELSE {c} + 0.30 * len(regexp_extract_all({t}, '[第条]')) / length({t})::DOUBLE - 0.18 * len(regexp_extract_all({t}, '[0-9]')) / length({t})::DOUBLE - 0.18 * len(regexp_extract_all({t}, '[(]')) / length({t})::DOUBLE - 0.04 * greatest(length({t}) - 3, 0) - 0.06 * len(regexp_extract_all({t}, '[(]')) END)"
    (a, ac), (b, bc), (c, cc) = stub_sql(50), stub_sql(100), stub_sql(30)
    return with_views("crops", more=f"""k AS (SELECT page_id, det_id, is_vertical, t1, t2, t3, {score('t1', 'c1')} AS s1, {score('t2', 'c2')} AS s2, {score('t3', 'c3')} AS s3 FROM (SELECT *, {a} AS t1, {ac} AS c1, {b} AS t2, {bc} AS c2, {c} AS t3, {cc} AS c3 FROM crops)),
      b2 AS (SELECT *, CASE WHEN s2 > s1 + 0.03 THEN s2 ELSE s1 END AS s12, CASE WHEN s2 > s1 + 0.03 THEN t2 ELSE t1 END AS t12 FROM k)""") + " SELECT page_id, det_id, CASE WHEN is_vertical AND s3 > s12 + 0.03 THEN t3 ELSE t12 END AS text, round(CASE WHEN is_vertical AND s3 > s12 + 0.03 THEN s3 ELSE s12 END + 1e-9, 6) AS score FROM b2"


def _no_model_sql() -> str:
    text, conf = stub_sql(100)
    return with_views("crops", more=_cascade("crops", "f", _NEAR, 25, 45, 30, 50, 100)) + f" SELECT page_id, det_id, CASE WHEN length(text) >= 45 THEN {text} ELSE text END AS text, round(CASE WHEN length(text) >= 45 THEN {conf} ELSE mean_confidence END, 6) AS mean_confidence FROM f"


_LARGE = stub_sql(100)
SQL = {
    "det_build": with_views("detections") + f" SELECT {_B}, confidence AS score, char_count FROM detections",
    "det_clamp_valid": with_views("detections") + f" SELECT * FROM (SELECT page_id, det_id, class_name, least(greatest(x0, 0), {WIDTH}) AS x0, least(greatest(y0, 0), {HEIGHT}) AS y0, least(greatest(x1, 0), {WIDTH}) AS x1, least(greatest(y1, 0), {HEIGHT}) AS y1 FROM detections) WHERE x1 > x0 AND y1 > y0",
    "det_lines_only": with_views("detections") + f" SELECT {_B} FROM detections WHERE starts_with(class_name, 'line_')",
    "crop_boxes_cli": with_views("crops") + f" SELECT {_B}, is_vertical FROM crops",
    "crop_boxes_batch": with_views("detections", more=_BATCH) + f" SELECT {_B}, is_vertical FROM batch",
    "char_bucket": with_views("detections") + f" SELECT page_id, det_id, {_N} AS n, {_BUCKET} AS bucket, {_NEAR} AS near FROM detections",
    "bucket_histogram": with_views("detections") + f" SELECT {_BUCKET} AS bucket, count(*) AS n FROM detections GROUP BY 1",
    "reading_order": with_views("crops") + f" SELECT page_id, det_id, {_ORDER} AS line_idx FROM crops",
    "page_counts": with_views("detections") + " SELECT page_id, count(*) AS total, count_if(starts_with(class_name, 'line_')) AS n_lines FROM detections GROUP BY page_id",
    "line_json_ids": with_views("crops") + f" SELECT page_id, det_id, {_ORDER} AS line_idx, '[[' || x0 || ',' || y0 || '],[' || x0 || ',' || y1 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || ']]' AS box, greatest(x1 - x0, 1) AS w, greatest(y1 - y0, 1) AS h FROM crops",
    "mock_layout": f"WITH {_SIZES}, {_mock('sizes', 'm')} SELECT page_id, det_id, confidence, x0, y0, x1, y1 FROM m",
    "fallback_pages": with_views("detections", more=f"f AS (SELECT {_B} FROM detections WHERE (page_id % 3 <> 0 OR class_name = 'block_fig') AND starts_with(class_name, 'line_')), pg AS (SELECT o_orderkey AS page_id, {WIDTH} AS width, {HEIGHT} AS height, 3 AS want, 1.0 AS c FROM orders WHERE o_orderkey NOT IN (SELECT page_id FROM f)), {_mock('pg', 'm')}") + f" SELECT {_B} FROM f UNION ALL SELECT page_id, det_id, 'line_main', x0, y0, x1, y1 FROM m",
    "input_union": f"SELECT path FROM (SELECT regexp_replace(url, '[?#].*$', '') || (['.png', '.TIF', '.gif', ''])[(page_id % 4 + 1)::INT] AS path FROM pages UNION ALL SELECT 'one/' || c_custkey || (['.png', '.TIF', '.gif', ''])[(c_custkey % 4 + 1)::INT] FROM customer) WHERE {_SUFFIX}",
    "supported_ext": f"SELECT page_id, {_SUFFIX} AS ok FROM (SELECT page_id, url || (['.png', '.TIF', '.gif', '', '.Jp2'])[(page_id % 5 + 1)::INT] AS path FROM pages)",
    "row_ink": _PIXELS + " SELECT page_id, y, ink FROM ink",
    "line_spans": _PIXELS + " SELECT page_id, span, y0, y1 FROM spans",
    "line_bands": _PIXELS + " SELECT page_id, span, x0, y0, x1, y1 FROM bands",
    "detect_bands": _PIXELS + " SELECT page_id, span AS det_id, 'line_main' AS class_name, x0, y0, x1, y1, 1.0::DOUBLE AS score, 100.0::DOUBLE AS char_count FROM bands",
    "fallback_bands": _PIXELS + f" SELECT page_id, span AS det_id, 'line_main' AS class_name, x0, y0, x1, y1, {_BUCKET} AS char_count FROM bands",
    "argmax_decode": with_views("logits", more=_TOKENS) + f" SELECT line_id, coalesce(string_agg(substr('{CHARSET}', i::INT, 1), '' ORDER BY t) FILTER (t < stop), '') AS text FROM (SELECT *, coalesce(min(CASE WHEN i = 0 THEN t END) OVER (PARTITION BY line_id), 99) AS stop FROM am) GROUP BY line_id",
    "decode_confidence": with_views("logits", more=_TOKENS) + f" SELECT line_id, coalesce(string_agg(substr('{CHARSET}', i::INT, 1), '' ORDER BY t) FILTER (t < stop), '') AS text, round(coalesce(avg(p) FILTER (t < stop), 0), 6) AS mean_confidence FROM (SELECT *, coalesce(min(CASE WHEN i = 0 OR (t >= 2 AND p < 0.35) THEN t END) OVER (PARTITION BY line_id), 99) AS stop FROM am) GROUP BY line_id",
    "cascade_closure": with_views("crops", more=_cascade("crops", "f", "char_count", 25, 45, 30, 50, 100)) + " " + _FOUND + "f",
    "cascade_pool": with_views("crops", more=_cascade("crops", "f", _NEAR, 25, 45, 30, 50, 100)) + " " + _FOUND + "f",
    "cascade_cli": with_views("crops", more=_cascade("crops", "f", _NEAR, 20, 40, 100, 50, 100)) + " " + _FOUND + "f",
    "cascade_no_model": _no_model_sql(),
    "split_long": with_views("crops", more=f"f1 AS (SELECT *, {_LARGE[0]} AS text, {_LARGE[1]} AS mean_confidence FROM crops), " + _split("f1", "f2", 60)) + " " + _FOUND + "f2",
    "rerank": _rerank_sql(),
    "run_page": with_views("detections", more=_BATCH + ", " + _cascade("batch", "f", "char_count", 25, 45, 30, 50, 100)) + f" SELECT page_id, {_ORDER} AS line_idx, text, round(confidence, 6) AS confidence FROM f",
    "recognize_page": _RECOGNIZED + ", " + ", ".join([TQ.keep_text("done", "a1"), TQ.cleaned("a1", "a2"), TQ.context("a2", "a3"), TQ.digits("a3", "a4"), TQ.hyphens("a4", "a5"), TQ.distinct_neighbours("a5", "a6")]) + " SELECT page_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM a6 GROUP BY page_id",
    "mock_page": f"WITH {_SIZES}, {_mock('sizes', 'm')} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY v DESC, CASE WHEN v THEN -x0 ELSE y0 END, CASE WHEN v THEN y0 ELSE x0 END, det_id) - 1 AS line_idx, 'mock100' AS text, confidence, true AS is_vertical FROM (SELECT *, y1 - y0 > x1 - x0 AS v FROM m)",
    "page_batch": with_views("detections", more=f"b AS (SELECT *, {_ORDER} AS line_idx FROM (SELECT *, y1 - y0 > x1 - x0 AS is_vertical FROM detections WHERE confidence > 0.3 AND {_INSIDE}))") + rf" SELECT page_id, line_idx, text, round(mean_confidence, 6) AS mean_confidence FROM (SELECT *, {_LARGE[0]} AS text, {_LARGE[1]} AS mean_confidence FROM b) WHERE mean_confidence >= 0 AND regexp_matches(text, '[^\s]')",
    "out_xml": _RECOGNIZED + f", g AS (SELECT page_id, string_agg({_LINE}, '' ORDER BY line_idx) AS body FROM done GROUP BY page_id) SELECT o_orderkey AS page_id, {_XML} AS xml FROM orders LEFT JOIN g ON o_orderkey = page_id",
    "out_text": _RECOGNIZED + " SELECT page_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM done GROUP BY page_id",
    "char_errors": _METRICS + " SELECT system, relpath, char_errors, char_total, round(CASE WHEN char_total > 0 THEN char_errors / char_total::DOUBLE WHEN char_errors > 0 THEN 1.0 ELSE 0.0 END, 9) AS cer FROM fm",
    "cer_wer": _METRICS + " SELECT system, matched, char_errors, char_total, round(cer, 9) AS cer FROM sm",
    "systems_ranked": _METRICS + ", " + _MISSING + " SELECT row_number() OVER (ORDER BY sm.cer, sm.system) AS place, sm.system, matched, count(m.relpath) AS missing, round(sm.cer, 9) AS cer FROM sm LEFT JOIN missing m USING (system) GROUP BY sm.system, matched, sm.cer",
    "word_errors": _WORDS,
    "evaluation_cube": _cube_sql(),
    "order_restored": _RESTORED,
    "page_totals": with_views("crops") + " SELECT count(DISTINCT page_id) AS pages, count(*) AS lines FROM crops",
    "output_stems": r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 's' || page_id ELSE coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', '') || (['.png', '/', '/.x', ''])[(page_id % 4 + 1)::INT], '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1'), ''), 'output') END AS stem FROM pages",
    "out_json": _RECOGNIZED + f", g AS (SELECT page_id, string_agg({_ITEM}, ',' ORDER BY line_idx) AS body FROM done GROUP BY page_id) SELECT o_orderkey AS page_id, '{{\"contents\":[[' || coalesce(body, '') || ']],\"imginfo\":{{\"img_width\":1000,\"img_height\":1200,\"img_path\":\"in/' || o_orderkey || '\",\"img_name\":\"p<' || o_orderkey || '\"}}}}' AS json FROM orders LEFT JOIN g ON o_orderkey = page_id",
    "cer_delta": _METRICS + " SELECT s.system, round(s.cer, 9) AS cer, round(s.cer - b.cer, 9) AS delta_cer FROM sm s, sm b WHERE b.system = 'lower'",
    "missing_files": with_views("pred", more=_MISSING) + " SELECT system, relpath FROM missing",
    "missing_top30": with_views("pred", more=_MISSING) + " SELECT system, rank, relpath, greatest(total - 30, 0) AS more FROM (SELECT system, relpath, row_number() OVER (PARTITION BY system ORDER BY relpath) AS rank, count(*) OVER (PARTITION BY system) AS total FROM missing) WHERE rank <= 30",
    "timing_summary": "SELECT count(*) AS files, round(sum(value), 3) AS total_seconds, round(avg(value), 6) AS mean_seconds FROM events",
    "fixture_stem": r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'law_129AC0_x' ELSE left(trim(regexp_replace(regexp_replace(replace(regexp_extract(url, '^\w+://([^/?#]*)', 1), ':', '_') || '_' || coalesce(nullif(replace(trim(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1), '/'), '/', '_'), ''), 'page'), '[^0-9A-Za-z_.\-]+', '_', 'g'), '_+', '_', 'g'), '_'), 120) END AS stem FROM pages""",
    "crop_pixels": with_views("pixels") + " SELECT page_id, count(*) AS n, sum(r * place)::BIGINT AS r, sum(g * place)::BIGINT AS g, sum(b * place)::BIGINT AS b FROM (SELECT *, ((y - 5) * (50 - page_id % 40) + x - 10 - page_id % 40) % 13 AS place FROM pixels WHERE x >= 10 + page_id % 40 AND x < 60 AND y >= 5 AND y < 25) GROUP BY page_id",
    "prep_recognizer": _RECOGNIZER,
    "prep_detector": _DETECTOR,
}
