"""Accuracy of predicted texts: character and word error rates over paired files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.distance import char_distance
from vellum.session import ship


def file_metrics(truth: DataFrame, predictions: DataFrame, level: str = "basic") -> DataFrame:
    """(system, relpath, char_errors, char_total, word_errors, word_total, cer, wer) of every predicted file with a truth."""
    ship(truth.sparkSession)
    pairs = truth.select("relpath", F.col("text").alias("truth")).join(predictions, "relpath")
    a, b = T.normalize(F.col("truth"), level), T.normalize(F.col("text"), level)
    df = pairs.select("system", "relpath", a.alias("a"), b.alias("b"))
    df = df.select("system", "relpath", char_distance(F.col("a"), F.col("b")).alias("char_errors"), F.length("a").alias("char_total"), T.word_distance(F.col("a"), F.col("b")).alias("word_errors"), T.word_count(F.col("a")).alias("word_total"))
    rate = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.col(n)).otherwise(F.when(F.col(e) > 0, 1.0).otherwise(0.0))
    return df.withColumns({"cer": rate("char_errors", "char_total"), "wer": rate("word_errors", "word_total")})


#: Compared systems.
MOST_SYSTEMS = 1000


def systems_of(predictions: DataFrame, most: int = MOST_SYSTEMS) -> list[str]:
    """The names of the compared systems, which are configuration: more than ``most`` are an error."""
    names = [r.system for r in predictions.select("system").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} systems")
    return sorted(names)


def missing_files(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(system, relpath) of truth files that a system did not predict."""
    names = F.array(*map(F.lit, systems_of(predictions))).cast("array<string>")
    wanted = truth.select(F.explode(names).alias("system"), "relpath")
    return wanted.join(predictions.select("system", "relpath"), ["system", "relpath"], "left_anti")


def require_all(missing: DataFrame) -> None:
    """Fails if any system lacks a file."""
    first = missing.orderBy("system", "relpath").first()
    if first:
        raise ValueError(f"{missing.count()} missing predictions, the first {first.system}: {first.relpath}")


def system_metrics(metrics: DataFrame) -> DataFrame:
    """Micro averages per system."""
    sums = metrics.groupBy("system").agg(F.count(F.lit(1)).alias("matched"), *[F.sum(c).alias(c) for c in ("char_errors", "char_total", "word_errors", "word_total")])
    rate = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.col(n)).otherwise(0.0)
    return sums.withColumns({"cer": rate("char_errors", "char_total"), "wer": rate("word_errors", "word_total")})


def with_missing(systems: DataFrame, missing: DataFrame) -> DataFrame:
    """Adds the number of missing files of each system."""
    counted = missing.groupBy("system").agg(F.count(F.lit(1)).alias("missing"))
    return systems.join(counted, "system", "left").fillna(0, ["missing"])


def deltas(systems: DataFrame, baseline: str) -> DataFrame:
    """Each system against the baseline's row; without one there is nothing to compare and the result is empty."""
    base = systems.where(F.col("system") == baseline).select("cer", "wer").first()
    if base is None:
        base, systems = (0.0, 0.0), systems.limit(0)
    return systems.select("system", "cer", "wer", (F.col("cer") - base[0]).alias("delta_cer"), (F.col("wer") - base[1]).alias("delta_wer"))


def ranked(systems: DataFrame) -> DataFrame:
    """Systems by character error rate, best first, ties by name. They are configuration: more than MOST_SYSTEMS are an error, as one task ranks them."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cer", "system"))
    return systems.withColumn("place", F.when(place <= MOST_SYSTEMS, place).otherwise(F.raise_error(F.lit(f"more than {MOST_SYSTEMS} systems")).cast("int")))


def cube(truth: DataFrame, predictions: DataFrame, levels: tuple[str, ...] = ("none", "basic", "strict"), baseline: str | None = None) -> DataFrame:
    """(level, system, is_total, matched, missing, char_errors, char_total, word_errors, word_total, cer, wer, delta_cer, delta_wer).

    A row for each normalisation level and system, and one for all systems of a level (system null), in one pass over the pairs.
    Deltas are against the baseline's row of the same level; null without one. A truth without a prediction is missing at every level.
    """
    ship(truth.sparkSession)
    pairs = truth.select("relpath", F.col("text").alias("truth")).join(predictions, "relpath")
    forms = F.array(*[F.struct(F.lit(level).alias("level"), T.normalize(F.col("truth"), level).alias("a"), T.normalize(F.col("text"), level).alias("b")) for level in levels])
    files = pairs.select("system", F.explode(forms).alias("f")).select("system", "f.*")
    a, b = F.col("a"), F.col("b")
    files = files.select("level", "system", char_distance(a, b).alias("char_errors"), F.length(a).alias("char_total"), T.word_distance(a, b).alias("word_errors"), T.word_count(a).alias("word_total"))
    counts = [F.count(F.lit(1)).alias("matched"), *[F.sum(c).alias(c) for c in ("char_errors", "char_total", "word_errors", "word_total")]]
    sums = files.groupingSets([["level", "system"], ["level"]], "level", "system").agg(*counts, (F.grouping("system") == 1).alias("is_total"))
    absent = missing_files(truth, predictions).rollup("system").agg(F.count(F.lit(1)).alias("missing"), (F.grouping("system") == 1).alias("all_")).withColumnRenamed("system", "of_")
    joined = sums.join(absent, sums["system"].eqNullSafe(absent["of_"]) & (sums["is_total"] == absent["all_"]), "left").drop("of_", "all_").fillna(0, ["missing"])
    rate = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.col(n)).otherwise(0.0)
    rated = joined.withColumns({"cer": rate("char_errors", "char_total"), "wer": rate("word_errors", "word_total")})
    base = lambda c: F.max(F.when(~F.col("is_total") & (F.col("system") == baseline), F.col(c))).over(Window.partitionBy("level"))
    out = rated.withColumns({f"delta_{c}": F.col(c) - base(c) for c in ("cer", "wer")})
    return out.select("level", "system", "is_total", "matched", "missing", "char_errors", "char_total", "word_errors", "word_total", "cer", "wer", "delta_cer", "delta_wer")


def top_missing(missing: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` missing files of each system and how many more there are: a report's list."""
    ranked = missing.withColumn("rank", F.row_number().over(Window.partitionBy("system").orderBy("relpath")))
    counted = missing.groupBy("system").agg(F.count(F.lit(1)).alias("total"))
    return ranked.where(F.col("rank") <= n).join(counted, "system").select("system", "rank", "relpath", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def timing_summary(timing: DataFrame) -> DataFrame:
    return timing.agg(F.count(F.lit(1)).alias("files"), F.sum("wall_seconds").alias("total_seconds"), F.avg("wall_seconds").alias("mean_seconds"))


def page_totals(lines: DataFrame, seconds: float | None = None, against: float | None = None) -> DataFrame:
    """(pages, lines, ratio): lines over all pages, and how many times faster ``seconds`` is than ``against``, null if either is not known."""
    ratio = F.lit(against / seconds if seconds and against is not None else None).cast("double")
    return lines.agg(F.countDistinct("page_id").alias("pages"), F.count(F.lit(1)).alias("lines")).withColumn("ratio", ratio)


def timed(systems: dict, keep) -> DataFrame:
    """(stem, wall_seconds): runs each named query to its end by ``keep`` (a function that writes a DataFrame) and measures it."""
    import time

    rows, spark = [], None
    for name, df in systems.items():
        began = time.perf_counter()
        keep(name, df)
        rows.append((name, time.perf_counter() - began))
        spark = df.sparkSession
    if spark is None:
        raise ValueError("nothing to measure")
    return spark.createDataFrame(rows, "stem string, wall_seconds double")
