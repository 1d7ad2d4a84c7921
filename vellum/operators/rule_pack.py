"""User rules: literal dictionaries and rule packs, given as plain data or YAML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.page_rules import drop_repeats, merge_pairs


@dataclass(frozen=True)
class MergeRule:
    left_suffix: str
    right_prefix: str
    drop_right_prefix_chars: int = 0


@dataclass(frozen=True)
class RulePack:
    line_replacements: tuple[tuple[str, str], ...] = ()
    merge_rules: tuple[MergeRule, ...] = ()
    collapse_duplicate_adjacent_lines: bool = False


def load_yaml(body: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML rules needs the yaml package; pass plain data instead") from e
    return yaml.safe_load(body)


def dictionary(data) -> list[tuple[str, str]]:
    """Ordered (from, to) pairs from a list of mappings, {"replacements": list} or YAML of either; empty ``from`` are dropped."""
    data = load_yaml(data) if isinstance(data, str) else data
    data = data.get("replacements", []) if isinstance(data, dict) else data
    return [(r["from"], r["to"]) for r in data if r["from"]]


def rule_pack(data) -> RulePack:
    """A rule pack from a mapping or YAML; rules with an empty ``from``, suffix or prefix are dropped."""
    data = (load_yaml(data) if isinstance(data, str) else data) or {}
    merges = [MergeRule(r["left_suffix"], r["right_prefix"], r.get("drop_right_prefix_chars", 0)) for r in data.get("merge_rules", [])]
    return RulePack(
        tuple((r["from"], r["to"]) for r in data.get("line_replacements", []) if r["from"]),
        tuple(m for m in merges if m.left_suffix and m.right_prefix),
        bool(data.get("collapse_duplicate_adjacent_lines", False)),
    )


def apply_dictionary(lines: DataFrame, pairs) -> DataFrame:
    return lines.withColumn("text", T.replace_all(F.col("text"), pairs))


def apply_merges(lines: DataFrame, rules) -> DataFrame:
    """The first rule whose suffix and prefix fit joins a line with the next; merged lines do not merge again."""
    if not rules:
        return lines
    left, right = T.trim_end(F.col("text")), T.trim_start(F.col("next_text"))
    fits = [left.endswith(r.left_suffix) & right.startswith(r.right_prefix) for r in rules]
    made = F.coalesce(*[F.when(f, F.concat(left, F.substring(right, F.lit(1 + r.drop_right_prefix_chars), F.length(right)))) for f, r in zip(fits, rules, strict=True)])
    return merge_pairs(lines, F.coalesce(made.isNotNull(), F.lit(False)), made)


def apply_pack(lines: DataFrame, pack: RulePack) -> DataFrame:
    """Merges, then replacements, then the collapse of repeated lines."""
    out = apply_dictionary(apply_merges(lines, pack.merge_rules), pack.line_replacements)
    return drop_repeats(out) if pack.collapse_duplicate_adjacent_lines else out
