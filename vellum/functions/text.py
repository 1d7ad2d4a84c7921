"""Text repair as column expressions: white space, runs, repeated chunks, brackets, headings, stems."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.distance import list_distance

#: Phrases whose repeats collapse, literal replacements, and bracket pairs.
PHRASES = ("という。", "このように, ")
REPLACEMENTS = (("調示", "開示"), ("圖示", "開示"), ("単又は乙", "甲又は乙"))
BRACKETS = (("(", ")"), ("（", "）"), ("「", "」"), ("『", "』"), ("【", "】"))
#: Code points that count as body text, as Japanese-like, and as CJK ideographs.
TEXTUAL = "぀-ヿ㐀-䶿一-鿿Ａ-Ｚａ-ｚ"
JAPANESE = "぀-ヿ㐀-䶿一-鿿々。、「」（）"
CJK = "㐀-䶿一-鿿々"
#: Characters with the Unicode property White_Space.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BOUNDARY = r"(?U)^\s*(第|\(|（|1\.)"


def trim(c: Column) -> Column:
    """Strips Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def bound(c: Column, f) -> Column:
    """f(c) with ``c`` worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def limit_runs(c: Column) -> Column:
    """At most 4 equal ASCII digits, 3 equal symbols, 8 equal characters in a row; white space folds to one space and ends a run."""
    c = F.regexp_replace(c, r"([0-9])\1{4,}", "$1$1$1$1")
    c = F.regexp_replace(c, r"(?U)([^\p{IsAlphabetic}\p{N}\s])\1{3,}", "$1$1$1")
    c = F.regexp_replace(c, r"(?U)(\S)\1{8,}", "$1$1$1$1$1$1$1$1")
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def collapse_chunks(c: Column) -> Column:
    """A chunk of 10 down to 2 characters that stands three times or more in a row stays twice; longer chunks are tried first."""
    return F.regexp_replace(c, r"(?s)(.{2,10})\1{2,}", "$1$1")  # greedy, so each place tries ten characters first


def collapse_phrases(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, f"(?:{p}){{2,}}", p), PHRASES, c)


def _bracket_step(acc: Column, ch: Column, keep: Column) -> Column:
    openers, closers = "".join(o for o, _ in BRACKETS), "".join(c for _, c in BRACKETS)
    opens = ch.isin(*openers)
    partner = F.translate(ch, closers, openers)
    closes = ch.isin(*closers)
    matches = closes & (F.right(acc.stack, F.lit(1)) == partner)
    stack = F.when(opens, F.concat(acc.stack, ch)).when(matches, F.substring(acc.stack, F.lit(1), F.length(acc.stack) - 1)).otherwise(acc.stack)
    return F.struct(stack.alias("stack"), keep(acc, ch, closes & ~matches).alias("out"))


def _characters(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def drop_unmatched_closers(c: Column) -> Column:
    """Closing brackets that do not match the innermost open one go; unmatched openers stay."""
    closers = "[" + "".join(re.escape(x) for _, x in BRACKETS) + "]"
    return bound(c, lambda t: F.when(t.rlike(closers), bound(_characters(t), _matched)).otherwise(t))


def _matched(characters: Column) -> Column:
    zero = F.struct(F.lit("").alias("stack"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        moved = _bracket_step(a, x, lambda acc, ch, bad: F.when(bad, F.array_append(acc.out, acc.at)).otherwise(acc.out))
        return F.struct(moved.stack.alias("stack"), moved.out.alias("out"), (a.at + 1).alias("at"))

    def without(gone: Column) -> Column:
        return F.array_join(F.filter(F.transform(characters, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "")

    return bound(F.aggregate(characters, zero, step, lambda a: a.out), without)  # places of the few closers that go


def unmatched_brackets(c: Column) -> Column:
    """Closers without their opener on top of the stack, plus openers left open."""
    zero = F.struct(F.lit("").alias("stack"), F.lit(0).alias("out"))
    others = "[^" + "".join(re.escape(x) for pair in BRACKETS for x in pair) + "]+"
    step = lambda a, x: _bracket_step(a, x, lambda acc, ch, bad: acc.out + bad.cast("int"))
    return bound(F.regexp_replace(c, others, ""), lambda b: F.aggregate(_characters(b), zero, step, lambda a: a.out + F.length(a.stack)))


def replace_all(c: Column, pairs) -> Column:
    """Literal replacements in order; each sees the result of the one before. Empty ``from`` values are skipped."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [p for p in pairs if p[0]], c)


def sanitize(c: Column) -> Column:
    """The clean-up of recognised text: runs, chunks, phrases, brackets, literal replacements, in this order."""
    return replace_all(drop_unmatched_closers(collapse_phrases(collapse_chunks(limit_runs(c)))), REPLACEMENTS)


def is_decoration(c: Column) -> Column:
    """Blank, or at most three characters without body text."""
    t = trim(c)
    return (F.length(t) == 0) | ((F.length(t) <= 3) & ~t.rlike(f"[{TEXTUAL}]"))


def is_boundary(c: Column) -> Column:
    return c.rlike(BOUNDARY)


def _first(c: Column, what: str) -> Column:
    return F.instr(c, what)


def clean_line(c: Column) -> Column:
    """Trims; tidies article headings, tails after short parenthetical labels, and numbered-item prefixes."""
    return bound(trim(c), lambda t: F.when(F.left(t, F.lit(1)).isin("第", "(", "（"), _clean(t)).otherwise(t))  # few lines begin so


def _clean(t: Column) -> Column:
    at = _first(t, "条(")
    opened = F.when(at > 0, F.overlay(t, F.lit("条（"), at, F.lit(2))).otherwise(t)
    return F.when(t.startswith("第") & t.contains("条"), bound(opened, lambda o: _headed(o, at > 0))).otherwise(_item(t))


def _headed(opened: Column, article: Column) -> Column:
    """An article's heading without what follows its title."""
    close = F.when(article & (_first(opened, "）") == 0) & (_first(opened, ")") > 0), F.overlay(opened, F.lit("）"), _first(opened, ")"), F.lit(1))).otherwise(opened)
    cut = lambda p: F.substring(close, F.lit(1), p)
    wide, thin = _first(close, "）"), _first(close, ")")
    return (
        F.when(_first(close, ") 第") > 0, cut(_first(close, ") 第")))
        .when(_first(close, "） 第") > 0, cut(_first(close, "） 第")))
        .when((wide > 0) & (wide < F.length(close)), cut(wide))
        .when((thin > 0) & (thin < F.length(close)), cut(thin))
        .otherwise(close)
    )


def _item(t: Column) -> Column:
    """A numbered item's prefix, or a short label without its tail."""
    label = F.regexp_replace(t, r"^(\([^)]{0,8}\)|（[^）]{0,8}）)(?:のよう|によう)[぀-ゟ　 ]{5,}$", "$1")
    numbered = t.rlike(r"^(\([1-5]\)|（[1-5][)）])")
    return F.when(numbered, F.regexp_replace(t, r"^（([1-5])[)）]", "($1)")).when(t.rlike(r"^[(（]"), label).otherwise(t)


def normalize(c: Column, level: str) -> Column:
    """none, basic (newlines unified, white space folded in each line) or strict (basic without ASCII punctuation and spaces)."""
    if level == "none":
        return c
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]+", " ")
    c = F.regexp_replace(c, r"(?m)^ | $", "")
    if level == "strict":
        c = F.regexp_replace(c, r"[ !-/:-@\[-`{-~]", "")
    return trim(c)


def clean_truth(c: Column) -> Column:
    """Reference text: lines folded, runs of blank lines to one, none at the ends."""
    c = F.regexp_replace(normalize(c, "basic"), "\n{2,}", "\n\n")
    return trim(c)


def stem(c: Column) -> Column:
    """A file stem: other characters become underscores; an empty one becomes ``fixture``."""
    s = F.regexp_replace(F.regexp_replace(trim(c), r"[^0-9A-Za-z_.\-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("_")), F.lit("")), F.lit("fixture"))


def url_stem(url: Column) -> Column:
    """``law_<id>`` for /law/ addresses, else host and path, at most 120 characters; ``host_page`` for what is no address."""
    u = trim(url)
    path, host = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.lit("host"))
    law = F.regexp_extract(path, "/law/([^/?#]+)", 1)
    page = F.coalesce(F.nullif(F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_")), F.lit("")), F.lit("page"))
    other = F.substring(stem(F.concat_ws("_", F.replace(host, F.lit(":"), F.lit("_")), page)), 1, 120)
    return F.when(law != "", stem(F.concat(F.lit("law_"), law))).otherwise(other)


def escape_xml(c: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&apos;")] if quotes else [])
    return replace_all(c, pairs)


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character, 1 at least."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length)), F.lit(1))


def excess_run(c: Column, most: int) -> Column:
    """By how much the longest run of one character is longer than ``most``; only runs that are longer become values."""
    long = F.regexp_extract_all(c, F.lit(rf"(?s)(.)\1{{{most},}}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(long, F.length)) - most, F.lit(0))


def quality_score(text: Column, confidence: Column, blank_runs: bool = True) -> Column:
    """Confidence, plus body text, minus digits, symbols, long runs and unmatched brackets; -1 for an empty text.

    Counted penalties are whole hundredths, divided once, so that scores a margin apart compare as such. Without ``blank_runs`` a run of
    white space is no long run.
    """
    n = F.length(text).cast("double")
    japanese, digits = F.regexp_count(text, F.lit(f"[{JAPANESE}]")), F.regexp_count(text, F.lit("[0-9]"))
    symbols = F.regexp_count(text, F.lit(rf"(?U)[^\p{{IsAlphabetic}}\p{{N}}\s{JAPANESE}]"))
    runs = text if blank_runs else F.regexp_replace(text, r"(?U)\s+", " ")
    score = confidence + 0.30 * japanese / n - 0.18 * digits / n - 0.18 * symbols / n - 4 * excess_run(runs, 3) / 100.0 - 6 * unmatched_brackets(text) / 100.0
    return F.when(F.length(text) == 0, -1.0).otherwise(score)


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over white-space words, for any number of distinct ones."""
    return list_distance(word_list(a), word_list(b))


def word_count(c: Column) -> Column:
    return F.size(word_list(c))
