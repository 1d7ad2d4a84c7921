"""Queries over lines of text: repair, page rules, rule packs, normalisation, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import page_rules as R
from vellum.operators import rule_pack as P
from vellum.plans import views as V
from vellum.plans.views import WS, with_views

PAIRS = (("the", "DER"), ("DERe", "x"), ("", "never"), ("tion", "ción"))
PACK = P.RulePack((("an", "AN"), ("ANd", "&")), (P.MergeRule("s", "the", 1), P.MergeRule("e.", "the", 0), P.MergeRule("n", "e", 1), P.MergeRule("d", "t", 0)), True)
BODY = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
IDEOGRAPH = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}々]"
PAGE = "(PARTITION BY page_id ORDER BY line_idx)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def trim_start(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def trim_end(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def boundary(x: str) -> str:
    return rf"regexp_matches({x}, '^{WS}*(第|\(|（|1\.)')"


def keep_text(source: str, out: str) -> str:
    return f"{out} AS (SELECT page_id, line_idx, text FROM (SELECT *, {trim('text')} AS t FROM {source}) WHERE NOT (length(t) = 0 OR (length(t) <= 3 AND NOT regexp_matches(t, '{BODY}'))))"


def cleaned(source: str, out: str) -> str:
    head = "CASE WHEN instr(t, '条(') > 0 THEN substr(t, 1, instr(t, '条(') - 1) || '条（' || substr(t, instr(t, '条(') + 2) ELSE t END"
    close = "CASE WHEN instr(t, '条(') > 0 AND instr(o, '）') = 0 AND instr(o, ')') > 0 THEN substr(o, 1, instr(o, ')') - 1) || '）' || substr(o, instr(o, ')') + 1) ELSE o END"
    tail = "CASE WHEN instr(k, ') 第') > 0 THEN substr(k, 1, instr(k, ') 第')) WHEN instr(k, '） 第') > 0 THEN substr(k, 1, instr(k, '） 第')) WHEN instr(k, '）') > 0 AND instr(k, '）') < length(k) THEN substr(k, 1, instr(k, '）')) WHEN instr(k, ')') > 0 AND instr(k, ')') < length(k) THEN substr(k, 1, instr(k, ')')) ELSE k END"
    label = r"regexp_replace(t, '^(\([^)]{0,8}\)|（[^）]{0,8}）)(?:のよう|によう)[\x{3040}-\x{309F}\x{3000} ]{5,}$', '\1')"
    return rf"""{out} AS (SELECT page_id, line_idx, CASE WHEN starts_with(t, '第') AND contains(t, '条') THEN {tail}
        WHEN regexp_matches(t, '^(\([1-5]\)|（[1-5][)）])') THEN regexp_replace(t, '^（([1-5])[)）]', '(\1)') WHEN regexp_matches(t, '^[(（]') THEN {label} ELSE t END AS text
      FROM (SELECT *, {close} AS k FROM (SELECT *, {head} AS o FROM (SELECT page_id, line_idx, {trim('text')} AS t FROM {source}))))"""


def context(source: str, out: str) -> str:
    dangling = r"regexp_replace(regexp_replace(text, '\(1$', ''), '第$', '')"
    return f"{out} AS (SELECT page_id, line_idx, {trim(f'CASE WHEN coalesce({boundary("nx")}, false) THEN {dangling} ELSE text END')} AS text FROM (SELECT *, lead(text) OVER {PAGE} AS nx FROM {source}))"


def merged(source: str, out: str, test: str, made: str) -> str:
    """Greedy pairs: ``test`` and ``made`` use l and r, the trimmed line and the trimmed next one."""
    return f"""{out} AS (SELECT page_id, line_idx, CASE WHEN head THEN new ELSE text END AS text FROM (SELECT *, coalesce(lag(head) OVER {PAGE}, false) AS gone FROM (
      SELECT *, m AND (n - coalesce(last_value(CASE WHEN NOT m THEN n END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) % 2 = 1 AS head FROM (
      SELECT *, coalesce(nx IS NOT NULL AND ({test}), false) AS m, {made} AS new, row_number() OVER {PAGE} AS n FROM (
      SELECT *, {trim_end('text')} AS l, {trim_start('nx')} AS r FROM (SELECT page_id, line_idx, text, lead(text) OVER {PAGE} AS nx FROM {source}))))) WHERE NOT gone)"""


def digits(source: str, out: str) -> str:
    return merged(source, out, f"regexp_matches(l, '{IDEOGRAPH}[0-9]$') AND regexp_matches(r, '^{IDEOGRAPH}') AND NOT {boundary('r')}", "substr(l, 1, length(l) - 1) || r")


def hyphens(source: str, out: str) -> str:
    return f"""{out} AS (SELECT page_id, min(line_idx) AS line_idx, string_agg(CASE WHEN follows THEN substr({trim_end('h')}, 1, length({trim_end('h')}) - 1) ELSE h END, '' ORDER BY line_idx) AS text FROM (
      SELECT *, CASE WHEN j THEN {trim_start('text')} ELSE text END AS h, coalesce(lead(j) OVER {PAGE}, false) AS follows, sum((NOT j)::INT) OVER (PARTITION BY page_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
      SELECT page_id, line_idx, text, coalesce(regexp_matches({trim_end('p')}, '[A-Za-z]-$') AND regexp_matches({trim_start('text')}, '^[A-Za-z]') AND NOT {boundary(trim_start('text'))}, false) AS j FROM (
      SELECT *, lag(text) OVER {PAGE} AS p FROM {source}))) GROUP BY page_id, island)"""


def distinct_neighbours(source: str, out: str) -> str:
    return f"{out} AS (SELECT page_id, line_idx, text FROM (SELECT *, lag(text) OVER {PAGE} AS p FROM {source}) WHERE NOT coalesce(p = text, false))"


def pack_merges(source: str, out: str) -> str:
    tests = [f"(ends_with(l, '{r.left_suffix}') AND starts_with(r, '{r.right_prefix}'))" for r in PACK.merge_rules]
    made = "CASE " + " ".join(f"WHEN {t} THEN l || substr(r, {1 + r.drop_right_prefix_chars})" for t, r in zip(tests, PACK.merge_rules, strict=True)) + " END"
    return merged(source, out, " OR ".join(tests), made)


def replaced(pairs) -> str:
    x = "text"
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')" if a else x
    return x


def folded(x: str, level: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '{WS.replace(chr(92) + 'n', '')}+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m)^ | $', '', 'g')"
    if level == "strict":
        x = rf"regexp_replace({x}, '[ !-/:-@\[-`{{-~]', '', 'g')"
    return trim(x)


def brackets(result: str, bad: str, final: str) -> str:
    """A fold over the characters of ``text`` with a stack of open brackets; struct fields stack and o."""
    opens, closes = "'(', '（', '「', '『', '【'", "')', '）', '」', '』', '】'"
    partner = "translate(x, ')）」』】', '(（「『【')"
    step = f"""{{'stack': CASE WHEN x IN ({opens}) THEN acc.stack || x WHEN x IN ({closes}) AND right(acc.stack, 1) = {partner} THEN left(acc.stack, length(acc.stack) - 1) ELSE acc.stack END,
      'o': CASE WHEN x IN ({closes}) AND right(acc.stack, 1) <> {partner} THEN {bad} ELSE {result} END}}"""
    return f"list_reduce(CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END, lambda acc, x: {step}, {{'stack': '', 'o': {final}}})"


def runs(source: str, out: str) -> str:
    """Runs cut to their limits, by windows over characters; then white space folded."""
    return f"""{out}_ch AS (SELECT page_id, line_idx, unnest(string_split(text, '')) AS x, unnest(range(length(text))) AS p FROM {source}),
      {out}_rn AS (SELECT *, p - row_number() OVER (PARTITION BY page_id, line_idx, x ORDER BY p) AS g FROM {out}_ch),
      {out}_kp AS (SELECT page_id, line_idx, x, p, row_number() OVER (PARTITION BY page_id, line_idx, x, g ORDER BY p) AS n,
        CASE WHEN regexp_matches(x, '{WS}') THEN 1000000000 WHEN regexp_matches(x, '[0-9]') THEN 4 WHEN regexp_matches(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}]') THEN 3 ELSE 8 END AS most FROM {out}_rn),
      {out} AS (SELECT page_id, line_idx, regexp_replace({trim("string_agg(x, '' ORDER BY p)")}, '{WS}+', ' ', 'g') AS text FROM {out}_kp WHERE n <= most GROUP BY page_id, line_idx)"""


def chunks(source: str, out: str) -> str:
    """Chunks that repeat: where a character equals the one n places on for 2 n places, a chunk of n stands three times or more.
    The leftmost such place of a line is taken, with its longest chunk, then the next one behind it."""
    sizes = range(10, 1, -1)
    place = "PARTITION BY page_id, line_idx ORDER BY p"
    alike = ", ".join(f"coalesce(lead(x, {n}) OVER ({place}) = x, false) AS e{n}" for n in sizes)
    reach = ", ".join(f"min(CASE WHEN NOT e{n} THEN p END) OVER ({place} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - p AS r{n}" for n in sizes)
    size = "CASE " + " ".join(f"WHEN r{n} >= {2 * n} THEN {n}" for n in sizes) + " END"
    stop = "p + CASE " + " ".join(f"WHEN r{n} >= {2 * n} THEN {n} * (1 + r{n} // {n})" for n in sizes) + " END"
    step = "min(c.p) AS p, arg_min(c.n, c.p) AS n, arg_min(c.stop, c.p) AS stop"
    return f"""{out}_ch AS (SELECT page_id, line_idx, unnest(string_split(text, '')) AS x, unnest(range(length(text))) AS p FROM {source}),
      {out}_at AS MATERIALIZED (SELECT page_id, line_idx, p, {size} AS n, {stop} AS stop FROM (SELECT page_id, line_idx, p, {reach} FROM (SELECT *, {alike} FROM {out}_ch)) WHERE {size} IS NOT NULL),
      {out}_walk AS (SELECT page_id, line_idx, {step} FROM {out}_at c GROUP BY page_id, line_idx
        UNION ALL SELECT c.page_id, c.line_idx, {step} FROM {out}_walk k JOIN {out}_at c ON k.page_id = c.page_id AND k.line_idx = c.line_idx AND c.p >= k.stop GROUP BY c.page_id, c.line_idx),
      {out}_gone AS (SELECT page_id, line_idx, unnest(range(p + 2 * n, stop)) AS p FROM {out}_walk),
      {out} AS (SELECT page_id, line_idx, string_agg(x, '' ORDER BY p) AS text FROM {out}_ch ANTI JOIN {out}_gone USING (page_id, line_idx, p) GROUP BY page_id, line_idx)"""


def _lines(view, f):
    return lambda spark, sf: f(view(spark, sf)).select("page_id", "line_idx", "text")


QUERIES = {
    "page_text": lambda s, d: R.page_text(R.drop_repeats(R.drop_decoration(V.v_lines(s, d)))),
    "decoration": _lines(V.v_cjk, R.drop_decoration),
    "clean_line": _lines(V.v_cjk, R.clean_lines),
    "context_trim": _lines(V.v_cjk, R.trim_context),
    "cjk_merge": _lines(V.v_cjk, R.merge_split_digits),
    "hyphen_join": _lines(V.v_wrapped, R.join_hyphenated),
    "dedup_adjacent": _lines(V.v_lines, R.drop_repeats),
    "structure_rules": _lines(V.v_cjk, R.structural_rules),
    "structure_rules_latin": _lines(V.v_wrapped, R.structural_rules),
    "dict_apply": _lines(V.v_lines, lambda df: P.apply_dictionary(df, PAIRS)),
    "rulepack_replace": _lines(V.v_lines, lambda df: P.apply_dictionary(df, PACK.line_replacements)),
    "rulepack_merge": _lines(V.v_lines, lambda df: P.apply_merges(df, PACK.merge_rules)),
    "rulepack_all": _lines(V.v_wrapped, lambda df: P.apply_pack(df, PACK)),
    "run_limit": _lines(V.v_noisy, lambda df: df.withColumn("text", T.limit_runs(F.col("text")))),
    "chunk_collapse": _lines(V.v_noisy, lambda df: df.withColumn("text", T.collapse_chunks(F.col("text")))),
    "phrase_collapse": _lines(V.v_noisy, lambda df: df.withColumn("text", T.collapse_phrases(F.col("text")))),
    "bracket_repair": _lines(V.v_noisy, lambda df: df.withColumn("text", T.drop_unmatched_closers(F.col("text")))),
    "fixed_replace": _lines(V.v_noisy, lambda df: df.withColumn("text", T.replace_all(F.col("text"), T.REPLACEMENTS))),
    "sanitize": _lines(V.v_noisy, lambda df: df.withColumn("text", T.sanitize(F.col("text")))),
    "quality": lambda s, d: V.v_noisy(s, d).select("page_id", "line_idx", F.round(T.quality_score(F.col("text"), F.lit(0.7)) + 1e-9, 6).alias("score")),
    "normalize_basic": lambda s, d: V.table(s, d, "documents").select("doc_id", T.normalize(F.col("text"), "basic").alias("text")),
    "normalize_strict": lambda s, d: V.table(s, d, "documents").select("doc_id", T.normalize(F.col("text"), "strict").alias("text")),
    "truth_cleanup": lambda s, d: V.table(s, d, "documents").select("doc_id", T.clean_truth(F.col("text")).alias("text")),
    "docx_body": lambda s, d: _docx(s, d),
}


def _docx(spark, sf):
    from vellum.sources.sinks import docx_body

    return V.table(spark, sf, "documents").where("text is not null").select("doc_id", docx_body(F.col("text")).alias("body"))


ALL = " SELECT page_id, line_idx, text FROM "
phrases = "regexp_replace(regexp_replace(text, '(?:という。){2,}', 'という。', 'g'), '(?:このように, ){2,}', 'このように, ', 'g')"
_structure = lambda v: with_views(v, more=", ".join([keep_text(v, "a1"), cleaned("a1", "a2"), context("a2", "a3"), digits("a3", "a4"), hyphens("a4", "a5"), distinct_neighbours("a5", "a6")])) + ALL + "a6"
_score = r"""0.7::DOUBLE + 0.30 * len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}々。、「」（）]')) / length(text)::DOUBLE
  - 0.18 * len(regexp_extract_all(text, '[0-9]')) / length(text)::DOUBLE
  - 0.18 * len(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}々。、「」（）]')) / length(text)::DOUBLE"""
SQL = {
    "page_text": with_views("lines", more=keep_text("lines", "a1") + ", " + distinct_neighbours("a1", "a2")) + " SELECT page_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM a2 GROUP BY page_id",
    "decoration": with_views("cjk", more=keep_text("cjk", "a1")) + ALL + "a1",
    "clean_line": with_views("cjk", more=cleaned("cjk", "a1")) + ALL + "a1",
    "context_trim": with_views("cjk", more=context("cjk", "a1")) + ALL + "a1",
    "cjk_merge": with_views("cjk", more=digits("cjk", "a1")) + ALL + "a1",
    "hyphen_join": with_views("wrapped", more=hyphens("wrapped", "a1")) + ALL + "a1",
    "dedup_adjacent": with_views("lines", more=distinct_neighbours("lines", "a1")) + ALL + "a1",
    "structure_rules": _structure("cjk"),
    "structure_rules_latin": _structure("wrapped"),
    "dict_apply": with_views("lines") + f" SELECT page_id, line_idx, {replaced(PAIRS)} AS text FROM lines",
    "rulepack_replace": with_views("lines") + f" SELECT page_id, line_idx, {replaced(PACK.line_replacements)} AS text FROM lines",
    "rulepack_merge": with_views("lines", more=pack_merges("lines", "a1")) + ALL + "a1",
    "rulepack_all": with_views("wrapped", more=pack_merges("wrapped", "a1") + f", a2 AS (SELECT page_id, line_idx, {replaced(PACK.line_replacements)} AS text FROM a1), " + distinct_neighbours("a2", "a3")) + ALL + "a3",
    "run_limit": with_views("noisy", more=runs("noisy", "a1")) + ALL + "a1",
    "chunk_collapse": with_views("noisy", more=chunks("noisy", "a1"), recursive=True) + ALL + "a1",
    "sanitize": with_views("noisy", more=", ".join([runs("noisy", "a1"), chunks("a1", "a2"), f"a3 AS (SELECT page_id, line_idx, {phrases} AS text FROM a2)", f"a4 AS (SELECT page_id, line_idx, ({brackets('acc.o || x', 'acc.o', chr(39) * 2)}).o AS text FROM a3)"]), recursive=True)
    + f" SELECT page_id, line_idx, {replaced(T.REPLACEMENTS)} AS text FROM a4",
    "phrase_collapse": with_views("noisy") + f" SELECT page_id, line_idx, {phrases} AS text FROM noisy",
    "bracket_repair": with_views("noisy") + f" SELECT page_id, line_idx, ({brackets('acc.o || x', 'acc.o', chr(39) * 2)}).o AS text FROM noisy",
    "fixed_replace": with_views("noisy") + f" SELECT page_id, line_idx, {replaced(T.REPLACEMENTS)} AS text FROM noisy",
    "quality": with_views("noisy", more=f"q AS (SELECT page_id, line_idx, text, {brackets('acc.o', 'acc.o + 1', '0')} AS b FROM noisy), "
    "ch AS (SELECT page_id, line_idx, unnest(string_split(text, '')) AS x, unnest(range(length(text))) AS p FROM noisy), "
    "rn AS (SELECT page_id, line_idx, max(n) AS best FROM (SELECT page_id, line_idx, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY page_id, line_idx, x ORDER BY p) AS g FROM ch) GROUP BY page_id, line_idx, x, g) GROUP BY page_id, line_idx)")
    + f" SELECT q.page_id, q.line_idx, round(CASE WHEN length(text) = 0 THEN -1.0 ELSE {_score} - 0.04 * greatest(best - 3, 0) - 0.06 * (b.o + length(b.stack)) END + 1e-9, 6) AS score FROM q LEFT JOIN rn USING (page_id, line_idx)",
    "normalize_basic": f"SELECT doc_id, {folded('text', 'basic')} AS text FROM documents",
    "normalize_strict": f"SELECT doc_id, {folded('text', 'strict')} AS text FROM documents",
    "truth_cleanup": rf"SELECT doc_id, {trim('regexp_replace(' + folded('text', 'basic') + ', ' + chr(39) + chr(92) + 'n{2,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM documents",
    "docx_body": """SELECT doc_id, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' || chr(10) || '  <w:body>' ||
      CASE WHEN length(text) = 0 THEN '<w:p/>' ELSE array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda s: '<w:p><w:r><w:t xml:space="preserve">' || replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:r></w:p>'), '') END
      || '<w:sectPr/></w:body>' || chr(10) || '</w:document>' AS body FROM documents WHERE text IS NOT NULL""",
}
