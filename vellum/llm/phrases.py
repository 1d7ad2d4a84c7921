"""Phrase collocation mining.

Texts fall into pieces at punctuation, and equal pieces of a language become one with a multiplicity, so a paragraph that
many documents share is counted once, with its weight. N-grams are counted level by level, a phrase being frequent only if its words and
its pairs of words are: words, then pairs of frequent words, then runs of three to five words of frequent pairs. Tasks over
pieces emit their grams with weights, a shuffle deals these to buckets by their hash, and each bucket is summed by duckdb,
which spills what its memory limit cannot hold. What the next level has to know of the last is a bitmap of hashed
frequent grams, of bounded size: a bit that stands for several grams costs work, never a count.

A phrase is scored by its weakest cut. The counts of the two parts of each cut are asked for by requests that a shuffle
brings to the part's own count, and that come home as a join's rows; no table of counts is ever broadcast or collected.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import ship, stored
from vellum.llm.wordhash import _letters, mix, slices, word_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
#: A longer phrase takes the place of a part of it that it has at least this percentage of.
COVER = 100
UNKNOWN = "und"
BREAKS = r"[.,;:!?\x0A-\x0D]"
#: Bits of the bitmap for each frequent gram, and the bounds of its size (as powers of two): at most 16 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Grams gathered at a time, and rows that a task sums before it passes them on.
GATHER, HELD = 200_000, 1_500_000
MEMORY = "256MB"

_WORD = _letters(b" ")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])


def pieces(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language and how often they occur; words are parted by one space each."""
    lowered = F.translate(text.cast("string"), _UPPER, _LOWER)
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(lowered, BREAKS)).alias("piece"))
    spaced = F.when(F.col("piece").rlike("\t|  "), F.regexp_replace("piece", "[ \t]+", " ")).otherwise(F.col("piece"))
    rows = rows.select("lang", F.btrim(spaced, F.lit(" \t")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def codes(hashes: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of each run of ``n`` words, from the hashes of all words and of each word's language."""
    size = max(0, len(hashes) - n + 1)
    code = lang[:size].astype(np.uint64)
    for i in range(n):
        code = mix(code ^ hashes[i : i + size])
    return code


class Bitmap:
    """A set of codes that may say yes too often, never no."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(counts: DataFrame, n: int) -> Bitmap:
    """The bitmap of the phrases of ``n`` words in ``counts`` (lang, lang_hash, phrase). Its size is bounded, whatever their number."""
    bits = LEAST_BITS
    while bits < MOST_BITS and 1 << bits < BITS_EACH * counts.count():
        bits += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, _ = word_hashes(b.column(1), _WORD)
            lang = np.repeat(b.column(0).to_numpy().view(np.uint64), n)
            at = codes(hashes, lang, n)[::n] & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    set_bits = counts.select(F.xxhash64("lang").alias("lang_hash"), "phrase").mapInArrow(run, "word bigint, bit int")
    found = set_bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bitmap(words)


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return out.rename_columns(["lang", "phrase", "f"]).cast(_COUNTS)


def _grams(piece: pa.Array, lang: pa.Array, lang_hash: np.ndarray, m: np.ndarray, levels: Sequence[int], known: Bitmap | None, known_n: int) -> Iterator[pa.Table]:
    """Tables (lang, phrase, f), some rows repeated, of the grams of ``levels`` words whose runs of ``known_n`` words are all known."""
    hashes, ends = word_hashes(piece, _WORD)
    piece = piece.cast(pa.large_binary())
    _, offsets, values = piece.buffers()
    offsets = np.frombuffer(offsets, np.int64)[piece.offset : piece.offset + len(piece) + 1]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = np.flatnonzero(data == 32)
    starts, stops = np.sort(np.concatenate([offsets[:-1], space + 1])), np.sort(np.concatenate([offsets[1:], space]))
    of = np.repeat(np.arange(len(piece)), np.diff(ends, prepend=0))  # each word's piece
    left = ends[of] - np.arange(len(of))  # words from here to the end of the piece
    run = np.ones(len(of), bool)
    if known is not None:
        run[len(of) - known_n + 1 :] = False
        run[: len(of) - known_n + 1] = known.has(codes(hashes, lang_hash.view(np.uint64)[of], known_n))
    for n in levels:
        need = n if known is None else n - known_n + 1
        good = (left >= n)[: max(0, len(of) - n + 1)]
        for i in range(need if known is not None else 0):
            good = good & run[i : i + len(good)]
        places = np.flatnonzero(good)
        for a in range(0, len(places), GATHER):
            at = places[a : a + GATHER]
            begin, size = starts[at], stops[at + n - 1] - starts[at]
            into = np.concatenate([[0], np.cumsum(size)])
            text = data[np.repeat(begin - into[:-1], size) + np.arange(into[-1])]
            phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(into.astype(np.int64)), pa.py_buffer(text)])
            yield pa.table([lang.take(pa.array(of[at])), phrase.cast(pa.binary()), pa.array(m[of[at]])], schema=_COUNTS)


def counted(found: DataFrame, levels: Sequence[int], least: int, known: Bitmap | None = None, known_n: int = 1) -> DataFrame:
    """(lang, phrase, n, f) of all grams of ``levels`` words with a count of ``least`` or more, from pieces (lang, piece, m)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for b in slices(whole, 1):
                for t in _grams(b.column(1), b.column(0), b.column(3).to_numpy(), b.column(2).to_numpy(), levels, known, known_n):
                    held.append(t)
                    rows += t.num_rows
                    if rows >= HELD:
                        total = _summed(held)
                        if total.num_rows > HELD // 2:  # few repeats are left to find: pass them on
                            yield from total.to_batches(max_chunksize=50_000)
                            held, rows = [], 0
                        else:
                            held, rows = [total], total.num_rows
        if held:
            yield from _summed(held).to_batches(max_chunksize=50_000)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.register("grams", pa.RecordBatchReader.from_batches(_COUNTS, batches))
            sums = con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            yield from sums.to_arrow_reader(50_000)

    rows = found.select("lang", F.col("piece").cast("binary").alias("piece"), "m", F.xxhash64("lang").alias("lang_hash"))
    dealt = rows.mapInArrow(emit, "lang string, phrase binary, f bigint").repartition("lang", "phrase")
    kept = dealt.mapInArrow(bucket, "lang string, phrase binary, f bigint")
    spaces = F.length(F.col("phrase").cast("string")) - F.length(F.replace(F.col("phrase").cast("string"), F.lit(" "), F.lit("")))
    return stored(kept.select("lang", F.col("phrase").cast("string").alias("phrase"), (spaces + 1).cast("int").alias("n"), "f"), "phrases")


def frequent(found: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n, f): all phrases of one to ``longest`` words that occur ``least`` times or more, from the table of pieces."""
    words = counted(found, [1], least)
    out = words
    if longest > 1:
        pairs = counted(found, [2], least, bitmap(words, 1), 1)
        out = out.unionByName(pairs)
        if longest > 2:
            out = out.unionByName(counted(found, range(3, longest + 1), least, bitmap(pairs, 2), 2))
    return out


def _part(words: str, first: str, size: str) -> str:
    return f"array_join(slice({words}, {first}, {size}), ' ')"


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut (ties: the first)."""
    phrases = counts.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("n").alias("size"))
    cuts = phrases.select("*", F.split("phrase", " ").alias("ws"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.expr(f"stack(2, true, {_part('ws', '1', 'k')}, false, {_part('ws', 'k + 1', 'size - k')}) as (is_left, part)")
    requests = cuts.select("lang", "phrase", "a", "k", sides)
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda left: F.max(F.when(F.col("is_left") == left, F.col("f")))
    both = answers.groupBy("lang", "phrase", "a", "k").agg(side(True).alias("l"), side(False).alias("r")).join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19,0))"
    both = both.withColumn("score", F.expr(f"(cast(1000 as decimal(4,0)) * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})"))
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w"))
    return worst.select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")


def maximal(candidates: DataFrame, cover: int = COVER) -> DataFrame:
    """``candidates`` (lang, phrase, a, ...) without those that lie in a longer one with ``cover`` percent of their count or more."""
    longer = candidates.select("lang", F.split("phrase", " ").alias("ws"), F.col("a").alias("f")).where("size(ws) > 2")
    longer = longer.select("*", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("size"))
    inner = longer.select("lang", "f", F.explode(F.expr("sequence(1, size(ws) - size + 1)")).alias("at"), "ws", "size").select("lang", F.expr(_part("ws", "at", "size")).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(cover) * F.col("a"), F.lit(True))).drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, by score, count and then the phrase's bytes.

    A null text counts as the empty one, a null language as ``und``. Rows that repeat count as often as they occur. Texts of blanks and
    punctuation have no words; a text without punctuation is one piece, however long. A language without
    phrases of ``least`` occurrences has no rows, and an empty table gives an empty result. Other columns are not read.
    """
    ship(docs.sparkSession)
    found = stored(pieces(docs, F.col(text), F.col(lang)), "pieces")
    words = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(" "), F.lit(""))) + 1
    totals = found.groupBy("lang").agg(F.sum(F.col("m") * words).alias("n"))
    best = maximal(scored(frequent(found, least, longest), totals))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", *[F.col(c).cast("long").alias(c) for c in ("rank", "a", "l", "r", "n", "score")], "phrase")


#: DuckDB twin of ``collocations`` with its defaults, over ``documents``.
SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, m, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, piece, count(*) AS m FROM p GROUP BY ALL)),
t AS (SELECT lang, sum(m * len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM w, range(1, 6) r(s)),
c AS (SELECT lang, s, array_to_string(ws[i:i + s - 1], ' ') AS phrase, sum(m)::HUGEINT AS f FROM g GROUP BY ALL HAVING sum(m) >= 100),
k AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, s, unnest(range(1, s)) AS k FROM c WHERE s > 1),
x AS (
  SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score
  FROM k JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:k.s], ' ') JOIN t ON t.lang = k.lang),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, array_to_string(ws[j:j + z - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, s - z + 2)) AS j FROM (SELECT lang, f, s, string_split(phrase, ' ') AS ws, unnest(range(2, s)) AS z FROM c WHERE s > 2))),
o AS (SELECT y.* FROM y LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM i GROUP BY ALL) q USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
