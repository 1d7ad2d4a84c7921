"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Counts of every whole text become a vector of five transformed statistics. For each group of documents (language and
source; small groups are pooled by language, small pools together) the estimate starts from several sets of documents: those
closest to the coordinate-wise medians, by two norms, and random ones. Concentration steps follow: mean and covariance of the
closest three quarters, new distances, and so on. After two steps the two best starts of a group go on until their
determinants fall no more; the smaller one counts. A document is rejected if its squared Mahalanobis distance exceeds a chi-square quantile.

No statistic is known better than to one count, so each variance carries the square of what one more word, character,
symbol, repeated line or repeated window would change in the group's median document. That is far less than a statistic
scatters, unless it is the same in three quarters of the documents: there the estimate is that resolution alone.

All of it is aggregation: a group is a row of moments, never a list of its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import BROADCAST_ROWS, SPACES, cut, sized, stored, words

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
STATS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
DIM = len(STATS)
SUBSET = 0.75
#: 1 / consistency of the covariance of the central 75 % of a five-dimensional normal: 0.75 / P(chi2_7 <= q_0.75(chi2_5)).
CONSISTENCY = 1.41
#: The 0.99999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 30.86
MIN_GROUP = 60
#: Starts by random sets of documents, and how many are in one on average.
RANDOM_STARTS = 4
RANDOM_ROWS = 20
#: Steps that all starts take; then the BEST of each group go on.
FIRST_STEPS, BEST = 2, 2
#: A determinant has settled when its logarithm falls by less; steps lower it, so they end by themselves.
SETTLED = 1e-6
MAX_STEPS = 100
#: Pseudo-counts of words, characters and lines.
WORDS_MORE, CHARS_MORE, LINES_MORE = 50.0, 200.0, 10.0


def counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the base counts of every text, all in the row: no explode, no shuffle."""
    df = docs.select(*keep, words(text).alias("w_"), F.split(F.coalesce(text, F.lit("")), "\n").alias("l_"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    lines = F.filter("l_", lambda x: x.rlike(f"[^{SPACES}]"))
    df = df.withColumns({"h_": F.transform("w_", lambda x: F.xxhash64(x)), "n_words": F.size("w_").cast("long"), "word_chars": F.length(F.array_join("w_", "")).cast("long"), "l_": lines})
    df = df.withColumns({"n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"), "n_lines": F.size("l_").cast("long")}).drop("w_", "l_")
    starts = F.slice("h_", 1, F.greatest(F.size("h_") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("s_", F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("h_", i + k) for k in range(1, WINDOW)]))).drop("h_")
    # windows found twice or more: equal neighbours once sorted; most texts have none and stop at the size check
    pairs = F.sort_array(F.transform("s_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("p_", F.when(F.size(F.array_distinct("s_")) < F.size("s_"), pairs)).drop("s_")
    twice = F.filter(F.transform("p_", lambda x, i: F.when((x.h == F.get("p_", i - 1).h) | (x.h == F.get("p_", i + 1).h), x.i)), lambda x: x.isNotNull())
    df = df.withColumn("p_", F.sort_array(twice))
    gaps = F.transform("p_", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p_", i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")).drop("p_")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics. Ratios carry pseudo-counts, so that short texts do not scatter more than long ones."""
    n, chars = F.col("n_words"), F.col("word_chars")
    made = {
        "log_words": F.log1p(n),
        "word_length": (chars + 5.0 * WORDS_MORE) / (n + WORDS_MORE),
        "symbols": F.sqrt(F.col("n_symbols") / (chars + CHARS_MORE)),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + LINES_MORE),
        "repeats": F.col("n_repeat_words") / (n + WORDS_MORE),
    }
    return [made[k].cast("double").alias(k) for k in STATS]


def resolution() -> list[Column]:
    """What one more count changes in each statistic: a word, a character, a symbol, a repeated line, a repeated window."""
    n, chars = F.col("n_words"), F.col("word_chars")
    least = (1.0 / (n + 1), 1.0 / (n + WORDS_MORE), 1.0 / F.sqrt(chars + CHARS_MORE), 1.0 / (F.col("n_lines") + LINES_MORE), 2.0 * WINDOW / (n + WORDS_MORE))
    return [v.cast("double").alias(f"r_{k}") for k, v in zip(STATS, least, strict=True)]


#: What the estimates read of a document.
MEASURED = (*STATS, *[f"r_{k}" for k in STATS])


def groups(stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, grp): the group that each pair of language and source is judged in."""
    pairs = cut(stats.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n")))
    large = F.col("n") >= MIN_GROUP
    pools = pairs.where(~large).groupBy("g_lang").agg(F.sum("n").alias("pool"))
    own = F.concat_ws("/", F.lit("s"), F.length("g_lang").cast("string"), "g_lang", "g_source")
    pooled = F.when(F.col("pool") >= MIN_GROUP, F.concat_ws("/", F.lit("l"), "g_lang")).otherwise(F.lit("all"))
    return cut(pairs.join(pools, "g_lang", "left").select("g_lang", "g_source", F.when(large, own).otherwise(pooled).alias("grp")))


def _moments(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """Mean, inverse covariance and log determinant of each (grp, start); ``floors`` has each group's resolution.

    The inverse comes from Gauss-Jordan steps over the rows of [covariance | identity], written as one fold, so that the plan
    stays small.
    """
    x = list(STATS)
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.avg(k).alias(f"m{i}") for i, k in enumerate(x)]
    sums += [F.avg(F.col(x[i]) * F.col(x[j])).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)]
    out = rows.groupBy("grp", "start").agg(*sums).join(floors, "grp")

    def cell(i: int, j: int) -> Column:
        if j >= DIM:
            return F.lit(1.0 if j - DIM == i else 0.0)
        v = (F.col(f"q{max(i, j)}{min(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        return F.greatest(v, F.lit(0.0)) + F.col(f"r_{x[i]}") * F.col(f"r_{x[i]}") if i == j else v

    def eliminate(a: Column, k: Column) -> Column:
        pivot = F.get(F.get(a.rows, k), k)
        own = F.transform(F.get(a.rows, k), lambda v: v / pivot)
        other = lambda row: F.zip_with(row, own, lambda v, p: v - F.get(row, k) * p)
        rows_ = F.transform(a.rows, lambda row, i: F.when(i == k, own).otherwise(other(row)))
        return F.struct((a.log_det + F.log(pivot)).alias("log_det"), rows_.alias("rows"))

    whole = F.array(*[F.array(*[cell(i, j) for j in range(2 * DIM)]) for i in range(DIM)])
    zero = F.struct(F.lit(0.0).alias("log_det"), whole.alias("rows"))
    out = out.withColumn("a", F.aggregate(F.sequence(F.lit(0), F.lit(DIM - 1)), zero, eliminate))
    inverse = [F.get(F.get("a.rows", F.lit(i)), F.lit(DIM + j)).alias(f"i{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return cut(out.select("grp", "start", "n", F.col("a.log_det").alias("log_det"), *[f"m{i}" for i in range(DIM)], *inverse))


def _squared_distance() -> Column:
    total = F.lit(0.0)
    for i in range(DIM):
        off = lambda k: F.col(STATS[k]) - F.col(f"m{k}")
        row = F.col(f"i{i}{i}") * off(i)
        for j in range(i):
            row = row + 2 * F.col(f"i{i}{j}") * off(j)
        total = total + off(i) * row
    return total


def _closest(rows: DataFrame, small) -> DataFrame:
    """The rows (with a distance ``d``) of each (grp, start) up to the SUBSET quantile of ``d``, found by a mergeable sketch."""
    edge = rows.groupBy("grp", "start").agg(F.percentile_approx("d", SUBSET, 10_000).alias("edge"))
    return rows.join(small(edge), ["grp", "start"]).where("d <= edge")


def fit(stats: DataFrame) -> DataFrame:
    """(grp + MEASURED) -> one row of estimates per grp. ``stats`` should be materialised; each step reads it once."""
    names = list(STATS)
    medians = [F.percentile_approx(c, 0.5, 1000).alias(a) for c, a in [(k, f"c_{k}") for k in names] + [(f"r_{k}", f"r_{k}") for k in names]]
    centre = cut(stats.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), *medians))
    # all tables of groups have a row for each group and start at most
    few = centre.count() * (2 + RANDOM_STARTS) <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    floors = small(centre.select("grp", *[f"r_{k}" for k in names]))
    stats = stats.select("grp", *names)
    off = stats.join(small(centre), "grp").select("grp", "rows", *[f"r_{k}" for k in names], *names, *[F.abs(F.col(k) - F.col(f"c_{k}")).alias(f"a_{k}") for k in names])
    spread = cut(off.groupBy("grp").agg(*[F.percentile_approx(f"a_{k}", 0.5, 1000).alias(f"s_{k}") for k in names]))
    z = [F.col(f"a_{k}") / F.greatest(1.4826 * F.col(f"s_{k}"), F.col(f"r_{k}")) for k in names]
    norms = F.array(F.struct(F.lit(0).alias("start"), sum((v * v for v in z), F.lit(0.0)).alias("d")), F.struct(F.lit(1).alias("start"), F.greatest(*z).alias("d")))
    at = off.join(small(spread), "grp").select("grp", *names, F.explode(norms).alias("e")).select("grp", *names, "e.start", "e.d")
    dealt = F.shiftrightunsigned(F.xxhash64(F.col("k"), *names), 11) / float(1 << 53)
    drawn = off.select("grp", "rows", *names, F.explode(F.array(*[F.lit(2 + k) for k in range(RANDOM_STARTS)])).alias("k")).where(dealt * F.col("rows") < RANDOM_ROWS)
    model = _moments(_closest(at, small).select("grp", "start", *names).unionByName(drawn.select("grp", F.col("k").alias("start"), *names)), floors)

    def step(model: DataFrame) -> DataFrame:
        at = stats.join(small(model), "grp").select("grp", *names, "start", _squared_distance().alias("d"))
        return _moments(_closest(at, small), floors)

    for _ in range(FIRST_STEPS):
        model = step(model)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "start"))
    falling, settled = cut(model.withColumn("place", place).where(F.col("place") <= BEST).drop("place")), []
    for _ in range(MAX_STEPS):
        if falling.isEmpty():
            break
        after = cut(step(falling).join(falling.select("grp", "start", F.col("log_det").alias("was")), ["grp", "start"]))
        still = F.col("was") - F.col("log_det") > SETTLED
        settled.append(after.where(~still).drop("was"))
        falling = after.where(still).drop("was")
    model = reduce(DataFrame.unionByName, settled, falling)
    best = model.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    return cut(model.join(best, ["grp", "start"]).drop("start"))


def _counted(docs: DataFrame, keep: list[Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    keys = [F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("g_lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("g_source")]
    df = counts(docs, F.col(text_col), [*keep, *keys])
    # the id, which filters refer to, keeps them from being pushed into the projections below, where the array columns would be
    # worked out again for each element
    return df.select("*", *vector(), *resolution(), F.monotonically_increasing_id().alias("barrier_"))


def _where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition & (F.col("barrier_") >= 0))


def _apply(counted: DataFrame, where: DataFrame, model: DataFrame) -> DataFrame:
    placed = counted.join(sized(where), ["g_lang", "g_source"], "left").join(sized(model), "grp", "left")
    far = _squared_distance()
    return placed.withColumn("distance", F.when(~F.col("base_failed"), far)).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far > CUTOFF, F.lit(False)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row.

    A null or blank text has no words and fails the base rule. A null language or source counts as the empty string.
    Groups of under MIN_GROUP rows that passed the base rule are judged with the other small ones of their language,
    or with all small ones. Ties and repeated rows get equal results; null ids stay; very long texts are counted whole;
    other columns do not matter. An empty table gives an empty result.
    """
    stats = cut(_counted(docs, [F.col(id_col).alias("id_")], text_col, lang_col, source_col))
    passed = stats.where(~F.col("base_failed"))
    where = groups(passed)
    model = fit(cut(passed.join(sized(where), ["g_lang", "g_source"]).select("grp", *MEASURED)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return _apply(stats, where, model).select(F.col("id_").alias(id_col), *names)


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged and judged as above: null and blank texts go, repeated rows are judged
    alike, an empty table stays empty. Rows that pass the base rule are written once beside their
    statistics; the estimates read the statistics alone, and texts are never shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    passed = _where(_counted(docs, [row], text_col, lang_col, source_col), ~F.col("base_failed"))
    passed = stored(passed.select("row_", "base_failed", "g_lang", "g_source", *MEASURED), "quality")
    where = groups(passed)
    model = fit(cut(passed.join(sized(where), ["g_lang", "g_source"]).select("grp", *MEASURED)))
    return _apply(passed, where, model).where("kept").select("row_.*")
