"""Length cascade over pluggable line recognisers.

A recogniser is a function that adds ``text`` and ``mean_confidence`` to the line rows that it is given: built-in columns,
or a model of ``vellum.operators.models``. Stages are filters and unions, so a larger model sees only the lines that need it. What a
model has read is written to the shared folder once, and all branches that depend on it read it from there: no line is shown
to a model twice, whatever the number of branches, nor again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.session import written

Recognizer = Callable[[DataFrame], DataFrame]
FOUND = ("text", "mean_confidence")
KEYS = ("page_id", "det_id")


def sanitized(recognizer: Recognizer) -> Recognizer:
    """The recogniser with its texts cleaned, so that whoever looks at their length sees what is kept."""
    return lambda lines: recognizer(lines).withColumn("text", T.sanitize(F.col("text")))


def _unread(found: DataFrame) -> DataFrame:
    return found.drop(*FOUND)


def cascade(lines: DataFrame, small: Recognizer | None, middle: Recognizer | None, large: Recognizer, first: int | Column = 25, second: int | Column = 45, bucket: Column | None = None) -> DataFrame:
    """Lines of bucket 3 start with the small model, of 2 with the middle one, others with the large one; a text of ``first``
    (``second``) characters or more goes on to the next. A missing model is replaced by the large one.

    ``bucket`` defaults to the tolerant reading of char_count; pass ``F.col("char_count")`` for exact equality. The limits may be columns.
    """
    kind = G.near_bucket(F.col("char_count")) if bucket is None else bucket
    small, middle = small or large, middle or large
    rows = written(lines.withColumn("kind_", kind), "lines")
    three, two, rest = rows.where("kind_ = 3.0"), rows.where("kind_ = 2.0"), rows.where("not (kind_ <=> 3.0) and not (kind_ <=> 2.0)")
    short, n = F.col("kind_") == 3.0, F.length("text")
    begun = written(small(three).unionByName(middle(two)), "read")
    retried = written(middle(_unread(begun.where(short & (n >= first)))), "read")
    longer = _unread(begun.where(~short & (n >= second)).unionByName(retried.where(n >= second)))
    done = begun.where(F.when(short, n < first).otherwise(n < second)).unionByName(retried.where(n < second))
    return done.unionByName(large(rest.unionByName(longer))).drop("kind_")


def cascade_any_bucket(lines: DataFrame, small: Recognizer, middle: Recognizer, large: Recognizer, first: int = 25, second: int = 45) -> DataFrame:
    """The variant of the build without models: the second test applies to every bucket, the large one included."""
    out = written(cascade(lines, small, middle, large, first, second), "read")
    redo = F.length("text") >= second
    return out.where(~redo).unionByName(large(_unread(out.where(redo))))


def split_long(found: DataFrame, large: Recognizer, threshold: int | Column = 80) -> DataFrame:
    """Recognised texts of ``threshold`` characters on lines four times as wide as high are read again in two halves.

    A null threshold splits nothing. Lines are told apart by page_id and det_id.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    found = written(found, "read")
    long = F.coalesce((F.length("text") >= threshold) & (width >= 4 * height) & (F.expr("(x1 - x0) div 2") > 0), F.lit(False))
    todo = found.where(long)
    middle = F.expr("x0 + (x1 - x0) div 2")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("x0").alias("a"), middle.alias("z")), F.struct(F.lit(1).alias("half"), middle.alias("a"), F.col("x1").alias("z"))))
    parts = _unread(todo).withColumn("h_", halves).withColumns({"half": F.col("h_.half"), "x0": F.col("h_.a").cast("int"), "x1": F.col("h_.z").cast("int")}).drop("h_")
    read = large(parts).groupBy(*KEYS).agg(
        F.max(F.when(F.col("half") == 0, F.col("text"))).alias("left_"),
        F.max(F.when(F.col("half") == 1, F.col("text"))).alias("right_"),
        F.sum(F.col("mean_confidence") * F.length("text")).alias("weighted_"),
        F.sum(F.length("text")).alias("length_"),
    )
    joined = todo.join(read, list(KEYS), "left")
    some = F.coalesce(F.col("length_") > 0, F.lit(False))
    made = joined.withColumns({"text": F.when(some, F.concat("left_", "right_")).otherwise(F.col("text")), "mean_confidence": F.when(some, F.col("weighted_") / F.col("length_")).otherwise(F.col("mean_confidence"))})
    return found.where(~long).unionByName(made.select(*found.columns))


def rerank(candidates: Column, margin: float | Column = 0.03, score: Callable[[Column, Column], Column] = T.quality_score) -> Column:
    """The best of an ordered array of struct(text, mean_confidence): a later one wins only by more than ``margin`` of ``score``.

    Nulls in the array are skipped; the first entry is the base.
    """
    scored = F.transform(F.filter(candidates, lambda c: c.isNotNull()), lambda c: F.struct(score(c.text, c.mean_confidence).alias("score"), c.text.alias("text"), c.mean_confidence.alias("mean_confidence")))
    rest = lambda s: F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
    best = lambda s: F.aggregate(rest(s), F.get(s, F.lit(0)), lambda best, c: F.when(c.score > best.score + margin, c).otherwise(best))
    return T.bound(scored, best)  # each entry is scored once


def candidates(found: DataFrame, small: Recognizer | None, middle: Recognizer | None, large: Recognizer, first: int | Column = 25, second: int | Column = 45, threshold: int | Column = 80) -> DataFrame:
    """``found`` with ``candidates``: the base reading, the large model's, the small (middle) one's where the shape of
    the line says bucket 3 (2), and the large model's with long lines split, in this order; a model that is missing or not asked leaves none.

    Each further model is shown the lines of its own bucket only, once each.
    """
    base = written(found, "base")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind, lines = G.char_bucket(width, height, first, second), _unread(base)
    direct = written(large(lines), "direct")
    reading = lambda df, at: df.select(*KEYS, F.lit(at).alias("at_"), *FOUND)
    asked = [reading(direct, 1), reading(split_long(direct, large, threshold), 4)]
    asked += [reading(model(lines.where(kind == b)), at) for model, b, at in ((small, 3.0, 2), (middle, 2.0, 3)) if model]
    further = asked[0]
    for one in asked[1:]:
        further = further.unionByName(one)
    ordered = F.sort_array(F.collect_list(F.struct("at_", F.struct(*FOUND).alias("c"))))
    listed = further.groupBy(*KEYS).agg(F.transform(ordered, lambda x: x.c).alias("further_"))
    return base.join(listed, list(KEYS), "left").withColumn("candidates", F.concat(F.array(F.struct(*FOUND)), F.coalesce("further_", F.array().cast(listed.schema["further_"].dataType)))).drop("further_")


def boosted(found: DataFrame, small: Recognizer | None, middle: Recognizer | None, large: Recognizer, first: int | Column = 25, second: int | Column = 45, threshold: int | Column = 80, margin: float | Column = 0.03) -> DataFrame:
    """``found`` with the best of the ``candidates`` of each line in place of its reading."""
    best = rerank(F.col("candidates"), margin)
    ranked = candidates(found, small, middle, large, first, second, threshold).withColumn("best_", best)
    return ranked.withColumns({c: F.col(f"best_.{c}") for c in FOUND}).select(*found.columns)


def keep_confident(found: DataFrame, least: float | Column = 0.30, drop_blank: bool = True) -> DataFrame:
    kept = found.where(F.col("mean_confidence") >= least)
    return kept.where(~T.blank(F.col("text"))) if drop_blank else kept
