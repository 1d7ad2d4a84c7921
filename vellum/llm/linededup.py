"""Line dedup by overlapping three-line windows.

A window is three consecutive lines with a word; blank lines between them belong to it. Every window of every text is
hashed to 128 bits, the first occurrence (least id, then least text hash, then place) of each repeated window is
found by aggregation, and all lines that some later occurrence covers are removed. The positions of overlapping
windows are merged before the text is rebuilt. A removed line always has an earlier copy that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACES, cut, fresh

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, a, c, w1, w2): one row per window, from line a to line c (both from 0); t is a hash of the whole text."""
    text = F.col(text_col).cast("string")
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), _lines(text).alias("lines"))
    hashed = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), x.rlike(f"[^{SPACES}]").alias("full")))
    df = df.select("id", "t", F.filter(hashed, lambda x: x.full).alias("n"))
    starts = F.slice("n", 1, F.greatest(F.size("n") - (WINDOW - 1), F.lit(0)))

    def window(x: Column, i: Column) -> Column:
        second, third = F.get("n", i + 1), F.get("n", i + 2)
        return F.struct(x.at.alias("a"), third.at.alias("c"), F.xxhash64(x.h1, second.h1, third.h1).alias("w1"), F.xxhash64(x.h2, second.h2, third.h2).alias("w2"))

    return df.select("id", "t", F.explode(F.transform(starts, window)).alias("w")).select("id", "t", "w.*")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, gone): for each text with later occurrences, the sorted positions of the lines that they cover."""
    found = windows(docs, id_col, text_col)
    first = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "t", "a")).alias("f")).where("n > 1").select("w1", "w2", "f")
    later = found.join(first, ["w1", "w2"]).where(~(F.struct("id", "t", "a").eqNullSafe(F.col("f"))))
    spans = later.groupBy("id", "t").agg(F.collect_set(F.struct("a", "c")).alias("spans"))
    merged = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.a, s.c))))
    return spans.select("id", "t", F.sort_array(merged).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text rebuilt from the lines that stay, and two more columns: n_lines and n_removed.

    A text of fewer than three lines with a word has no window and stays whole. A null text stays null with 0 lines; the
    empty text has one empty line. A text whose lines all go becomes empty. Rows that share id and text are one
    occurrence: each keeps the same lines. Null ids come first in the order of occurrences. An empty table gives an
    empty result. Should ``docs`` have columns named n_lines or n_removed, the new ones get an underscore.
    """
    gone = covered(docs, id_col, text_col)
    text, n_lines, n_removed = F.col("text_"), fresh(docs, "n_lines"), fresh(docs, "n_removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).withColumn("t_", F.xxhash64("text_"))
    joined = rows.join(gone, rows["id_"].eqNullSafe(gone["id"]) & (rows["t_"] == gone["t"]), "left").select("row_", "text_", "gone")
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls_") - 1), F.col("gone"))
    rebuilt = joined.withColumn("ls_", F.when(F.col("gone").isNotNull(), lines))
    rebuilt = rebuilt.withColumn("kept_", F.when(F.col("gone").isNotNull(), kept))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("kept_", lambda i: F.get("ls_", i)), "\n"))
    total = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    columns = [new.alias(c) if c.lower() == text_col.lower() else F.col(f"row_.`{c}`").alias(c) for c in docs.columns]
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rebuilt.select(*columns, total.cast("long").alias(n_lines), removed.cast("long").alias(n_removed))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the remaining text, columns unchanged; ``length_col``, if there is one, counts its characters anew.

    Null, empty and very long texts, ties, repeated rows and clashing names are treated as in ``dedup_lines``; the length of a
    null text is null. An empty table gives an empty result.
    """
    out = dedup_lines(docs, id_col, text_col)
    kinds = dict(docs.dtypes)
    return out.select(*[F.length(text_col).cast(kinds[c]).alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """What the query returns: counts, length and SHA-256 of each document's remaining text. A null text has length 0 and no
    digest; all else is as in ``dedup_lines``, whose other columns are not read."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


#: DuckDB twin of ``digest``; ``{docs}`` is the relation it reads. Ids are taken to be distinct.
SQL = r"""
WITH d AS (SELECT doc_id, text FROM {docs}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos AS a, lead(pos, 2) OVER o AS c,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS body
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, a, c, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(a, c + 1)) AS pos FROM r WHERE nth > 1),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS body
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(length(body), 0) AS n_chars, sha256(body) AS text_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
