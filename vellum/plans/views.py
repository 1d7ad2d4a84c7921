"""Inputs that stand in for page images and model outputs: Spark views over the driver tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vellum.functions import geometry as G
from vellum.operators import layout
from vellum.session import ship

WIDTH, HEIGHT = 1000, 1200
CJK_FROM, CJK_TO = "teonhairdsu", "第条()1目の（）よう"
CLASSES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(G.CLASSES, 1)) + ") AS c(label, class_name)"
#: White space as RE2 has to be told of it.
WS = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
GLYPHS = "abc第条7(x"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).withColumn("line_idx", F.col("line_idx").cast("long"))


def _pieces(lines: DataFrame, size: int, cuts=lambda text: text) -> DataFrame:
    """Lines cut every ``size`` characters, in one walk over each; no line holds a newline, so one marks each cut, for ``cuts`` as well."""
    marked = cuts(F.regexp_replace("text", f"(?s)(.{{{size}}})(?=.)", "$1\n"))
    cut = lines.select("page_id", "line_idx", F.posexplode(F.split(marked, "\n")).alias("i", "text"))
    return cut.select("page_id", (F.col("line_idx") * 100000 + F.col("i")).alias("line_idx"), "text")


def v_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut every 40 characters, with a hyphen where the cut parts two ASCII letters."""
    return _pieces(v_lines(spark, sf), 40, lambda marked: F.regexp_replace(marked, "([A-Za-z])\n(?=[A-Za-z])", "$1-\n"))


def v_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut every 14 characters, some letters turned into the characters that the rules look for."""
    return _pieces(v_lines(spark, sf), 14).withColumn("text", F.translate(F.col("text"), CJK_FROM, CJK_TO))


NOISE = ("7777777", "!!!!!?!", "という。という。という。", "(a)b)）「」」（", "abcabcabcabc", "調示圖示単又は乙  \t x")


def v_noisy(spark: SparkSession, sf: str) -> DataFrame:
    noise = F.element_at(F.array(*map(F.lit, NOISE)), (F.pmod(F.col("page_id") + F.col("line_idx"), F.lit(len(NOISE))) + 1).cast("int"))
    return v_lines(spark, sf).withColumn("text", F.concat(F.col("text"), F.lit(" "), noise))


def v_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Detector rows in a space of 800 x 800."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*li.columns)
    q = F.col("l_quantity").cast("int")
    long, short = 16 + q * 8, 10 + F.col("l_linenumber") * 3
    tall = F.col("l_returnflag") == "R"
    df = li.withColumns({"det_id": F.row_number().over(w) - 1, "w": F.when(tall, short).otherwise(long), "h": F.when(tall, long).otherwise(short), "px": F.col("l_suppkey") * 7 % 600 - 20, "py": F.col("l_partkey") % 700 - 15})
    kinds = F.array(*[F.lit(x).cast("double") for x in (3.0, 2.0, 100.0, 2.9, 1.5, None)])
    return df.select(
        F.col("l_orderkey").alias("page_id"), "det_id", (F.col("l_partkey") % 19).cast("int").alias("label"), F.round(F.col("l_discount") * 10, 6).alias("score"),
        (F.col("px") + 0.3).cast("double").alias("x0"), (F.col("py") + 0.6).cast("double").alias("y0"), (F.col("px") + F.col("w") + 0.3).cast("double").alias("x1"), (F.col("py") + F.col("h") + 0.6).cast("double").alias("y1"),
        F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("char_count"),
    )


def v_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections in image space, all scores above 0.25."""
    built = layout.build_detections(v_raw(spark, sf), 0.25, F.lit(WIDTH / 800), F.lit(HEIGHT / 800))
    return built.select("page_id", "det_id", "class_name", F.col("score").alias("confidence"), *G.BOX, "char_count")


def v_crops(spark: SparkSession, sf: str) -> DataFrame:
    return layout.crop_boxes(v_detections(spark, sf), F.lit(WIDTH), F.lit(HEIGHT), 2)


def v_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def stub(k: int):
    """A deterministic recogniser of model size ``k``: text and confidence follow from the box."""

    def run(df: DataFrame) -> DataFrame:
        n = ((F.col("x1") - F.col("x0")) * 3 + (F.col("y1") - F.col("y0")) * 5 + k) % (k + k // 10 + 1)
        glyph = F.substring(F.lit(GLYPHS), (F.col("x0") % len(GLYPHS) + 1).cast("int"), F.lit(1))
        return df.withColumns({"text": F.repeat(glyph, n.cast("int")), "mean_confidence": ((F.col("x0") + F.col("y0") * 3 + k) % 90 + 5) / 100.0})

    return run


def stub_sql(k: int, prefix: str = "", x0: str | None = None, x1: str | None = None) -> tuple[str, str]:
    x0, x1, y0, y1 = x0 or f"{prefix}x0", x1 or f"{prefix}x1", f"{prefix}y0", f"{prefix}y1"
    n = f"((({x1}) - ({x0})) * 3 + ({y1} - {y0}) * 5 + {k}) % {k + k // 10 + 1}"
    return f"repeat(substr('{GLYPHS}', (({x0}) % {len(GLYPHS)} + 1)::INT, 1), ({n})::INT)", f"(((({x0}) + {y0} * 3 + {k}) % 90 + 5) / 100.0::DOUBLE)"


def v_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as 8 time steps of 8 class scores, scaled so that weak and strong peaks occur."""
    e = table(spark, sf, "embeddings")
    cell = lambda t: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.round(F.get("embedding", t * 8 + c).cast("double") * 20, 4))
    return e.select(F.col("vec_id").alias("line_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), cell).alias("logits"))


def v_packed(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, width, height, rgb): one page of 240 x 140 pixels per supplier, with dark bands, drawn as packed RGB rows."""
    ship(spark)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:140, :240]
        dark, light = (np.stack(shades, axis=2).astype(np.uint8) for shades in zip(*(((x * k + y) % 90, 225 + (x * k + y * 3) % 30) for k in (1, 2, 3)), strict=True))
        stripes = (x + y) % 5 < 3
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, pages = b.column(0).slice(at, 256), []
                for i in ids.to_pylist():
                    inset = i % 5
                    band = ((y[:, :1] + i * 3) % 41 < 14) & ((x[:1] >= 20 + inset * 5) & (x[:1] < 180 - inset * 7)) & stripes
                    pages.append(np.where(band[:, :, None], dark, light).tobytes())
                yield pa.RecordBatch.from_arrays([ids, pa.array(pages, pa.binary())], names=["page_id", "rgb"])

    # an id becomes 100 KB of pixels, so ids are dealt to all cores, whatever the number of files they come in
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("page_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    drawn = ids.mapInArrow(draw, "page_id bigint, rgb binary")
    return drawn.select("page_id", F.lit(240).alias("width"), F.lit(140).alias("height"), "rgb")


def v_truth(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.concat(F.lit("t/"), F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit(".txt")).alias("relpath"), "text", "item_id")


def v_pred(spark: SparkSession, sf: str) -> DataFrame:
    t = v_truth(spark, sf)
    return (
        t.select(F.lit("same").alias("system"), "relpath", "text")
        .unionByName(t.select(F.lit("lower").alias("system"), "relpath", F.lower("text").alias("text")))
        .unionByName(t.where("item_id % 7 <> 0").select(F.lit("vowels").alias("system"), "relpath", F.regexp_replace("text", "[aeiou]", "").alias("text")))
    )


_PIECE = "unnest(range(greatest(CAST(ceil(length(text) / {n}.0) AS BIGINT), 1)))"
SQL = {
    "lines": "lines AS (SELECT page_id, unnest(range(len(p))) AS line_idx, unnest(p) AS text FROM (SELECT doc_id AS page_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))",
    "wrapped": "wrapped AS (SELECT page_id, line_idx * 100000 + i AS line_idx, substr(text, 40 * i + 1, 40) || CASE WHEN regexp_matches(substr(text, 40 * i + 40, 2), '^[A-Za-z]{2}$') THEN '-' ELSE '' END AS text FROM (SELECT *, "
    + _PIECE.format(n=40) + " AS i FROM lines))",
    "cjk": f"cjk AS (SELECT page_id, line_idx * 100000 + i AS line_idx, translate(substr(text, 14 * i + 1, 14), '{CJK_FROM}', '{CJK_TO}') AS text FROM (SELECT *, " + _PIECE.format(n=14) + " AS i FROM lines))",
    "noisy": "noisy AS (SELECT page_id, line_idx, text || ' ' || ([" + ", ".join(f"'{n}'".replace("\t", "' || chr(9) || '") for n in NOISE) + f"])[((page_id + line_idx) % {len(NOISE)} + 1)::INT] AS text FROM lines)",
    "raw": """raw AS (SELECT page_id, det_id, label, score, px + 0.3::DOUBLE AS x0, py + 0.6::DOUBLE AS y0, px + w + 0.3::DOUBLE AS x1, py + h + 0.6::DOUBLE AS y1, char_count FROM (
      SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS det_id,
             (l_partkey % 19)::INT AS label, round(l_discount * 10, 6) AS score, l_suppkey * 7 % 600 - 20 AS px, l_partkey % 700 - 15 AS py,
             CASE WHEN l_returnflag = 'R' THEN 10 + l_linenumber * 3 ELSE 16 + trunc(l_quantity)::INT * 8 END AS w, CASE WHEN l_returnflag = 'R' THEN 16 + trunc(l_quantity)::INT * 8 ELSE 10 + l_linenumber * 3 END AS h,
             ([3.0, 2.0, 100.0, 2.9, 1.5, NULL]::DOUBLE[])[(l_partkey % 6 + 1)::INT] AS char_count FROM lineitem))""",
    "detections": f"detections AS (SELECT page_id, det_id, class_name, score AS confidence, trunc(x0 * 1.25::DOUBLE)::INT AS x0, trunc(y0 * 1.5::DOUBLE)::INT AS y0, trunc(x1 * 1.25::DOUBLE)::INT AS x1, trunc(y1 * 1.5::DOUBLE)::INT AS y1, coalesce(char_count, 100.0) AS char_count FROM raw JOIN {CLASSES_SQL} USING (label) WHERE score > 0.25)",
    "crops": f"""crops AS (SELECT page_id, det_id, class_name, confidence, char_count, greatest(x0 - 2, 0) AS x0, greatest(y0 - 2, 0) AS y0, least(x1 + 2, {WIDTH}) AS x1, least(y1 + 2, {HEIGHT}) AS y1,
      least(y1 + 2, {HEIGHT}) - greatest(y0 - 2, 0) > least(x1 + 2, {WIDTH}) - greatest(x0 - 2, 0) AS is_vertical FROM (
      SELECT * REPLACE (greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1) FROM detections WHERE starts_with(class_name, 'line_')) WHERE x1 > x0 AND y1 > y0 AND x1 <= {WIDTH} AND y1 <= {HEIGHT})""",
    "logits": "logits AS (SELECT vec_id AS line_id, t, c, round(embedding[t * 8 + c + 1]::DOUBLE * 20, 4) AS v FROM embeddings, range(8) r1(t), range(8) r2(c))",
    "pixels": """pixels AS (SELECT page_id, y, x, (CASE WHEN band THEN (x + y) % 90 ELSE 225 + (x + y * 3) % 30 END)::INT AS r, (CASE WHEN band THEN (x * 2 + y) % 90 ELSE 225 + (x * 2 + y * 3) % 30 END)::INT AS g, (CASE WHEN band THEN (x * 3 + y) % 90 ELSE 225 + (x * 3 + y * 3) % 30 END)::INT AS b FROM (
      SELECT s_suppkey::BIGINT AS page_id, y, x, (y + s_suppkey * 3) % 41 < 14 AND x >= 20 + s_suppkey % 5 * 5 AND x < 180 - s_suppkey % 5 * 7 AND (x + y) % 5 < 3 AS band FROM supplier, range(140) r1(y), range(240) r2(x)))""",
    "truth": r"truth AS (SELECT 't/' || lpad(item_id::VARCHAR, 6, '0') || '.txt' AS relpath, text, item_id FROM benchmark)",
    "pred": "pred AS (SELECT 'same' AS system, relpath, text FROM truth UNION ALL SELECT 'lower', relpath, lower(text) FROM truth UNION ALL SELECT 'vowels', relpath, regexp_replace(text, '[aeiou]', '', 'g') FROM truth WHERE item_id % 7 <> 0)",
}
NEEDS = {"wrapped": ("lines",), "cjk": ("lines",), "noisy": ("lines",), "detections": ("raw",), "crops": ("raw", "detections"), "pred": ("truth",)}


def with_views(*names: str, more: str = "", recursive: bool = False) -> str:
    """A WITH clause of the named views and what they need, and ``more`` after them."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([SQL[n] for n in order] + ([more] if more else []))
