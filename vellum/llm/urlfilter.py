"""URL filter: host-and-path rules, then gradient-boosted trees on lexical features.

The trees are Spark ML's, so fitting and scoring stay in the JVM. They are trained from labelled URLs. Where none are given,
``seed_labels`` labels a URL by a short list of terms that make up a whole hyphen-separated part of its host. The trees that
judge a site are then fitted on other sites only: sites are dealt into folds, and each fold is scored by the trees of the
others. So a verdict is never a label read back, and ``held_out`` tells what verdicts are worth on sites that were not seen.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, fresh, sized

#: The contract's rules as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The parts of a host name that label a URL as unwanted.
SEED_TERMS = ("ads", "adult", "bet", "bets", "casino", "loans", "lottery", "pills", "porn", "replica", "spam", "viagra", "warez", "xxx")
#: The trees are fitted on at most about this many distinct labelled URLs, chosen by hash; those of the folds share them.
SAMPLE_ROWS = 20_000
#: Parts that sites are dealt into where the labels are seed labels.
FOLDS = 5
#: A rule list is configuration; it becomes one expression.
MAX_RULES = 1_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "hyphens", "labels", "parameters", "suffix_rate", "suffix_share")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_text(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def match(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(rule_text(r)), r[2] == "block")):  # the last that fits wins; block wins a tie
        fits = ((host_col == r[0]) | host_col.endswith("." + r[0])) & path_col.startswith(r[1])
        rule, verdict = F.when(fits, rule_text(r)).otherwise(rule), F.when(fits, r[2]).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, from columns url_, host_ and path_."""
    url, h = F.coalesce("url_", F.lit("")), F.col("host_")
    df = df.withColumns({"chars_": F.split(h, ""), "n_": F.greatest(F.length(h), F.lit(1)).cast("double")})
    parts = F.transform(F.array_distinct("chars_"), lambda c: F.size(F.filter("chars_", lambda x: x == c)) / F.col("n_"))
    df = df.withColumn("entropy", F.when(F.length(h) > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    return df.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length(h).cast("double"),
        "depth": F.regexp_count("path_", F.lit("/[^/]")).cast("double"),
        "digit_ratio": count("[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.regexp_count(h, F.lit("[-_]")).cast("double"),
        "labels": F.regexp_count(h, F.lit("[^.]+")).cast("double"),
        "parameters": count("[?&][^=&#]+"),
        "suffix_": F.regexp_extract(h, r"([^.]*)$", 1),
    }).drop("chars_", "n_")


def seed_labels() -> Column:
    """1.0 if a hyphen-separated part of the host is a seed term, 0.0 if not, null without a host."""
    parts = F.split("host_", "[.\\-_]")
    return F.when(F.length("host_") > 0, F.arrays_overlap(parts, F.array(*map(F.lit, SEED_TERMS))).cast("double"))


def suffix_rates(by: DataFrame) -> DataFrame:
    """(suffix_, suffix_rate, suffix_share) from counts (suffix_, n, bad): the smoothed rate of unwanted URLs and the log share of each last host label."""
    rows, bad = by.agg(F.sum("n"), F.sum("bad")).first()
    rate = (F.col("bad") + 20.0 * bad / rows) / (F.col("n") + 20.0)
    return by.select("suffix_", rate.alias("suffix_rate"), F.log(F.col("n") / rows).alias("suffix_share"))


def with_suffixes(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``df`` with the statistics of its suffix, in its fold if ``suffixes`` has folds."""
    keys = [c for c in ("fold_", "suffix_") if c in suffixes.columns]
    return df.join(sized(suffixes), keys, "left").fillna({"suffix_rate": 0.0, "suffix_share": -20.0})


def sampled(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most about ``sample_rows`` distinct URLs of ``labelled``: those whose hash, as a fraction, falls below the share that gives that many."""
    share = min(1.0, sample_rows / max(1, labelled.agg(F.approx_count_distinct("url_", 0.01)).first()[0]))
    return labelled.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "url_"), 11) / float(1 << 53) < share).dropDuplicates(["url_", "label"])


def trained(ready: DataFrame, trees: int = 10, depth: int = 3, name: str = "") -> PipelineModel:
    """Trees from rows of FEATURES and label; the columns that they add carry ``name``."""
    features = VectorAssembler(inputCols=list(FEATURES), outputCol=f"features{name}_")
    gbt = GBTClassifier(featuresCol=f"features{name}_", labelCol="label", predictionCol=f"prediction{name}_", maxIter=trees, maxDepth=depth, seed=7)
    gbt = gbt.setRawPredictionCol(f"raw{name}_").setProbabilityCol(f"probability{name}_")
    return PipelineModel([features, gbt.fit(features.transform(ready))])


def fit(labelled: DataFrame, trees: int = 10, depth: int = 3, sample_rows: int = SAMPLE_ROWS) -> tuple[PipelineModel, DataFrame] | None:
    """Trees and suffix statistics from rows of (lexical features, suffix_, label). None unless both labels occur.

    A URL that repeats counts once for the trees (see ``sampled``). The suffix statistics take every labelled row.
    """
    labelled = labelled.where("label is not null")
    if labelled.select("label").distinct().count() < 2:
        return None
    suffixes = cut(suffix_rates(labelled.groupBy("suffix_").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))))
    ready = cut(with_suffixes(sampled(labelled, sample_rows), suffixes).select(*FEATURES, "label"))
    if ready.select("label").distinct().count() < 2:
        return None
    return trained(ready, trees, depth), suffixes


def fit_folds(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[PipelineModel | None], DataFrame]:
    """For each of FOLDS the trees of all other folds, and (fold_, suffix_, ...) statistics of all others; from one sample of labelled rows with fold_.

    The fits have small inputs and many small jobs, so they run side by side. A fold whose others lack a label has no trees, which is warned of.
    """
    counts = cut(labelled.groupBy("fold_", "suffix_").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")))
    sample = cut(sampled(labelled, sample_rows).select("fold_", "suffix_", "label", *[c for c in FEATURES if not c.startswith("suffix_")]))
    seen = {(r.fold_, r.label) for r in sample.select("fold_", "label").distinct().collect()}  # at most 2 * FOLDS rows

    def one(k: int) -> tuple[PipelineModel | None, DataFrame | None]:
        if len({label for fold, label in seen if fold != k}) < 2:
            warnings.warn(f"URLs of fold {k} of {FOLDS} are judged by rules only: the other folds have no wanted or no unwanted URLs", stacklevel=2)
            return None, None
        rates = suffix_rates(counts.where(F.col("fold_") != k).groupBy("suffix_").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
        ready = with_suffixes(sample.where(F.col("fold_") != k).drop("fold_"), rates).select(*FEATURES, "label")
        return trained(ready, name=str(k)), rates.withColumn("fold_", F.lit(k).cast("long"))

    with ThreadPoolExecutor(FOLDS) as pool:
        models, rates = zip(*pool.map(inheritable_thread_target(labelled.sparkSession)(one), range(FOLDS)), strict=True)
    some = [r for r in rates if r is not None]
    none = labelled.sparkSession.createDataFrame([], "suffix_ string, suffix_rate double, suffix_share double, fold_ bigint")
    return list(models), cut(reduce(DataFrame.unionByName, some)) if some else none


def site(host_col: Column) -> Column:
    """What hosts of one site have in common: the longest of the host's labels, the first of equally long ones."""
    longest = lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)
    return F.aggregate(F.split(host_col, r"\."), F.lit(""), longest)


def _read(df: DataFrame, url: str) -> DataFrame:
    """``df`` with url_, host_ and path_."""
    return df.withColumn("url_", F.col(url).cast("string")).withColumns({"host_": host(F.col("url_")), "path_": path(F.col("url_"))})


def _score(rows: DataFrame, fitted: tuple[PipelineModel, DataFrame] | None) -> DataFrame:
    if fitted is None:
        return rows.select("*", F.lit(0.0).alias("score"))
    model, suffixes = fitted
    scored = model.transform(with_suffixes(lexical(rows), suffixes)).withColumn("score", F.get(vector_to_array("probability_"), F.lit(1)))
    return scored.select(*rows.columns, "score")


def scored(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (with url_, host_ and path_) and their score: by the trees of ``labels``, or by those of the other folds."""
    if labels is not None:
        return _score(rows, fit(cut(lexical(_read(labels.select(F.col("url").alias("given_"), F.col("label").cast("double")), "given_")).drop("given_"))))
    fold = F.pmod(F.xxhash64(F.lit("fold"), site(F.col("host_"))), F.lit(FOLDS)).cast("long")
    features = lexical(rows).withColumn("fold_", fold)
    known = features.withColumn("label", seed_labels()).where("label is not null")
    models, suffixes = fit_folds(cut(known.select("url_", "fold_", "suffix_", "label", *[c for c in FEATURES if not c.startswith("suffix_")])))
    found = with_suffixes(features, suffixes)  # features are worked out once, and all models read them in one pass
    score = F.lit(0.0)
    for k, model in enumerate(models):
        if model is not None:
            found = model.transform(found)
            score = F.when(F.col("fold_") == k, F.get(vector_to_array(f"probability{k}_"), F.lit(1))).otherwise(score)
    return found.select(*rows.columns, score.alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    ``labels`` (url, label 0/1) trains the trees; without it the seed terms do, on other sites than the one that is judged: if these are
    all wanted or all unwanted, a warning says so and the URLs that no rule fits are allowed. A
    null URL, or one without ``://``, has an empty host and path, fits no rule and is scored like any other. If the labels are
    all alike, or there are none, URLs that no rule fits are allowed. Very long URLs are taken whole. Repeated rows get equal
    results; other columns do not matter; an empty table gives an empty result.
    """
    rows = _read(pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("given_")), "given_")
    rule, verdict = match(F.col("host_"), F.col("path_"), rules)
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored(rows, labels).select(F.col("id_").alias(id_col), F.col("host_").alias("host"), F.col("path_").alias("path"), rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")


def held_out(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """One row (n, bad, found, right): labelled URLs, those labelled unwanted, those that the trees of other sites block, and how
    many of these are labelled unwanted. right / found is the precision and right / bad the recall on sites not seen."""
    rows = _read(pages.select(F.col(url_col).alias("given_")), "given_")
    marked = scored(rows, None).select((F.col("score") > 0.5).alias("hit"), (seed_labels() == 1.0).alias("bad")).where("bad is not null")
    count = lambda c, name: F.count_if(c).alias(name)
    return marked.agg(F.count(F.lit(1)).alias("n"), count(F.col("bad"), "bad"), count(F.col("hit"), "found"), count(F.col("hit") & F.col("bad"), "right"))


def keep_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, columns unchanged. URLs are judged as above, each distinct one once; rows that
    repeat stay or go together, rows without a URL too."""
    key = fresh(pages, "judged_url")
    distinct = pages.select(F.col(url_col).alias(key)).distinct()
    allowed = judge(distinct, key, key).where("verdict = 'allow'").select(F.col(key).alias(key + "_"))
    return pages.join(allowed, pages[url_col].eqNullSafe(allowed[key + "_"]), "left_semi")
