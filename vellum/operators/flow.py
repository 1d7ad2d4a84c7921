"""Pages to text, end to end, with the options of each collection of pages.

Options are data: a small table of one row per collection is joined to the pages, and every stage takes its limits from the
row's own columns. So one plan serves collections with different settings. Optional stages are unions of the
rows that want them and the rows that do not; where no collection wants one, its branch is not planned at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import bands as B
from vellum.operators import cascade as C
from vellum.operators import layout as L
from vellum.operators import page_rules as R
from vellum.operators import rule_pack as P
from vellum.session import written

#: The options of a collection, with their kinds and defaults.
OPTIONS = {
    "use_detection": ("boolean", True),
    "det_conf_threshold": ("double", 0.25),
    "binarize_threshold": ("int", 220),
    "line_crop_padding": ("int", 0),
    "min_line_confidence": ("double", 0.30),
    "enable_cascade": ("boolean", True),
    "cascade_threshold_30_to_50": ("int", 25),
    "cascade_threshold_50_to_100": ("int", 45),
    "split_long_lines": ("boolean", True),
    "split_long_line_char_threshold": ("int", 80),
    "quality_boost": ("boolean", False),
    "quality_boost_min_delta": ("double", 0.03),
    "structure_rules": ("boolean", True),
    "post_dict": ("string", None),
    "rule_pack": ("string", None),
}
#: Collections are configuration: more are an error.
MOST = 1000


@dataclass(frozen=True)
class Models:
    """The recognisers, small to large; the small and the middle one may be missing."""

    large: C.Recognizer
    middle: C.Recognizer | None = None
    small: C.Recognizer | None = None


@dataclass(frozen=True)
class Rules:
    """The dictionaries and rule packs that options may name."""

    dictionaries: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)
    packs: Mapping[str, P.RulePack] = field(default_factory=dict)


def settings(spark, collections: Mapping[str, Mapping], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per collection: its options, and the defaults for those that it does not name. Unknown options, dictionaries and packs are errors."""
    rows = []
    if len(collections) > MOST:
        raise ValueError(f"more than {MOST} collections")
    for name, given in collections.items():
        if given.keys() - OPTIONS.keys():
            raise ValueError(f"{name}: unknown options {sorted(given.keys() - OPTIONS.keys())}")
        row = {k: given.get(k, default) for k, (_, default) in OPTIONS.items()}
        for option, known in (("post_dict", rules.dictionaries), ("rule_pack", rules.packs)):
            if row[option] is not None and row[option] not in known:
                raise ValueError(f"{name}: no {option} of the name {row[option]}")
        rows.append((name, *row.values()))
    return spark.createDataFrame(rows, "collection string, " + ", ".join(f"o_{k} {kind}" for k, (kind, _) in OPTIONS.items()))


def _o(name: str) -> Column:
    return F.col(f"o_{name}")


def _only(rows: DataFrame, wants: Column, stage, any_wants: bool) -> DataFrame:
    """``stage`` for the rows that want it; the others stay as they are."""
    if not any_wants:
        return rows
    return rows.where(~F.coalesce(wants, F.lit(False))).unionByName(stage(rows.where(wants)).select(*rows.columns))


def lines_of(pages: DataFrame, raw: DataFrame | None, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Line boxes (with the page's size and options) of each page: detections above its threshold, or bands of ink where there are none.

    ``raw`` has detector rows scaled to the page's pixels; pages need ``rgb`` for bands, and without it have none.
    """
    wide = pages.join(F.broadcast(chosen), "collection")
    sizes = wide.select("page_id", "width", "height", *columns)
    found = wide.sparkSession.createDataFrame([], "page_id bigint, det_id int, class_name string, confidence double, x0 int, y0 int, x1 int, y1 int, char_count double")
    if raw is not None:
        looked = raw.join(sizes.where(_o("use_detection")).select("page_id", _o("det_conf_threshold").alias("least_")), "page_id").where(F.col("score") > F.col("least_")).drop("least_")
        built = L.build_detections(looked, float("-inf"), F.lit(1.0), F.lit(1.0))
        found = L.lines_only(built.select("page_id", "det_id", "class_name", F.col("score").alias("confidence"), *G.BOX, "char_count"))
        found = written(found, "detections") if "rgb" in pages.columns else found
    if "rgb" in pages.columns:
        empty = wide.join(found.select("page_id"), "page_id", "left_anti")
        drawn = B.page_bands(empty, _o("binarize_threshold")).join(sizes.select("page_id", "o_cascade_threshold_30_to_50", "o_cascade_threshold_50_to_100"), "page_id")
        found = found.unionByName(L.bands_as_detections(drawn, first=_o("cascade_threshold_30_to_50"), second=_o("cascade_threshold_50_to_100")).select(*found.columns))
    return found.join(sizes, "page_id")


def read_lines(lines: DataFrame, models: Models, options: Sequence[Mapping]) -> DataFrame:
    """Text and confidence of line boxes: cascade, long lines in halves, and the re-rank for those that ask for it."""
    large, middle, small = (C.sanitized(m) if m else None for m in (models.large, models.middle, models.small))
    first, second = _o("cascade_threshold_30_to_50"), _o("cascade_threshold_50_to_100")
    any_ = lambda name: any(o[name] for o in options)
    threshold = F.when(_o("split_long_lines"), _o("split_long_line_char_threshold"))
    kind = F.when(_o("enable_cascade"), G.near_bucket(F.col("char_count"))).otherwise(100.0)
    if any_("enable_cascade"):
        found = C.cascade(lines, small, middle, large, first, second, kind)
    else:
        found = large(lines)
    if any_("split_long_lines"):
        found = C.split_long(found, large, threshold)
    if any_("quality_boost"):
        found = written(found, "found")
    return _only(found, _o("quality_boost"), lambda df: C.boosted(df, small, middle, large, first, second, threshold, _o("quality_boost_min_delta")), any_("quality_boost"))


def recognize_lines(pages: DataFrame, raw: DataFrame | None, collections: Mapping[str, Mapping], models: Models, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(page_id, collection, line_idx, box, is_vertical, text, confidence): the lines of every page in reading order, before page rules.

    Pages (page_id, collection, width, height, and rgb if there is any) of a collection that is not named are an error.
    """
    chosen = settings(pages.sparkSession, collections, rules)
    known = F.array(*map(F.lit, collections)).cast("array<string>")
    checked = F.when(F.array_contains(known, F.col("collection")), F.col("collection")).otherwise(F.raise_error(F.concat(F.lit("no options for collection "), F.coalesce("collection", F.lit("null")))))
    pages = pages.withColumn("collection", checked)
    options = [{k: c.get(k, d) for k, (_, d) in OPTIONS.items()} for c in collections.values()]
    boxes = lines_of(pages, raw, chosen, ["collection", *[c for c in chosen.columns if c != "collection"]])
    crops = L.crop_boxes(boxes, F.col("width"), F.col("height"), _o("line_crop_padding"))
    kept = C.keep_confident(read_lines(crops, models, options), _o("min_line_confidence"))
    for name, pairs in rules.dictionaries.items():
        if any(o["post_dict"] == name for o in options):
            kept = kept.withColumn("text", F.when(_o("post_dict") == name, T.replace_all(F.col("text"), pairs)).otherwise(F.col("text")))
    ordered = L.reading_order(kept)
    return ordered.select("page_id", "collection", "line_idx", *G.BOX, "is_vertical", "text", F.col("mean_confidence").alias("confidence"))


def recognize_pages(pages: DataFrame, raw: DataFrame | None, collections: Mapping[str, Mapping], models: Models, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(page_id, text) of every page that has a line left: ``recognize_lines``, then structural rules and the rule pack of its collection.

    A page without usable lines has no row. An empty table of pages gives an empty result.
    """
    found = recognize_lines(pages, raw, collections, models, rules)
    ways: dict[tuple, list[str]] = {}
    for name, given in collections.items():
        ways.setdefault((given.get("structure_rules", True), given.get("rule_pack")), []).append(name)
    found = written(found, "lines") if len(ways) > 1 else found
    out = None
    for (structured, pack), names in ways.items():  # a branch for each way that some collection goes
        lines = found.where(F.col("collection").isin(*names)).select("page_id", "line_idx", "text")
        lines = R.structural_rules(lines) if structured else lines
        lines = P.apply_pack(lines, rules.packs[pack]) if pack else lines
        out = lines if out is None else out.unionByName(lines)
    return R.page_text(out)


def recognize_line_images(lines: DataFrame, model: C.Recognizer) -> DataFrame:
    """(id, text) of images that are one line each: the large model alone, its text cleaned."""
    return C.sanitized(model)(lines).select("id", "text")


def mock_pages(pages: DataFrame, count: Column, confidence: Column, text: str, vertical: bool | None = None) -> DataFrame:
    """(page_id, line_idx, box, text, confidence, is_vertical): evenly spaced lines of one text in reading order, for trying out sinks."""
    boxes = L.mock_detections(pages, G.normalized_count(count, F.col("height")), confidence)
    lines = L.reading_order(boxes.withColumn("is_vertical", F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0")))
    upright = F.col("is_vertical") if vertical is None else F.lit(vertical)
    return lines.select("page_id", "line_idx", *G.BOX, F.lit(text).alias("text"), "confidence", upright.alias("is_vertical"))


def batch_lines(detections: DataFrame, width: Column, height: Column, model: C.Recognizer, least: float = 0.0) -> DataFrame:
    """The lines of whole pages by one recogniser: boxes that lie within the page, in reading order, numbered before empty readings go."""
    return C.keep_confident(model(L.reading_order(L.crop_boxes_batch(detections, width, height))), least)


def detailed_lines(detections: DataFrame, width: Column, height: Column, models: Models) -> DataFrame:
    """Every line box within the page with its cascade's reading, in reading order; nothing is dropped."""
    crops = L.crop_boxes_batch(detections, width, height)
    return L.reading_order(C.cascade(crops, models.small, models.middle, models.large, bucket=F.col("char_count")))
