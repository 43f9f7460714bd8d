"""Weighted keyword rules compiled to one column expression.

Rules are data: per category the keywords of its titles and its technology words, with weights, a least
score, overrides by title pattern and bonuses for some categories over others.  The compiler unrolls them into
``contains`` and ``rlike`` calls, so a table is classified in one projection without Python or a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """What a category is known by. ``order`` decides between equal scores (earlier wins)."""

    titles: dict[str, list[str]]
    slugs: dict[str, list[str]] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"title": 1.0, "normalized_title": 1.0, "tech_slugs": 0.8, "description": 0.4})
    least: float = 1.0
    other: str = "Other"
    overrides: tuple[tuple[str, str], ...] = ()
    bonuses: tuple[tuple[str, str, float], ...] = ()
    #: Categories that get so much more where their own title words are hit, whatever else is.
    lone_bonuses: tuple[tuple[str, float], ...] = ()


# What a named tie-breaker of a rules file does, overrides by title pattern, bonuses of one category over another.
TIE_BREAKERS: dict[str, dict] = {
    "ml_over_data_science": {"bonus": ("Machine Learning Science", "Data Science", 0.5)},
    "bi_over_data_science": {"bonus": ("Business Intelligence", "Data Science", 0.5)},
    "solutions_architect_override": {"override": (r"\bsolutions? architect\b", "Solutions Architect")},
    "security_override": {"override": (r"\bsecurity\b", "Security")},
}
# The category that its own title words always promote, and by how much.
PROMOTED = (("Project/Program/Product Management--Technical", 0.5),)


def load_rules(path: str, fallback: Rules | None = None) -> Rules:
    """Rules of a YAML (where a YAML reader is installed) or JSON file: ``rules: {category: {title, tech_slugs}}, tie_breakers, weights, min_score, categories``.

    A tie-breaker that is switched on does what ``TIE_BREAKERS`` says. A file that can't be read, or without rules, gives ``fallback``; without one it is an error.
    """
    import json

    try:
        with open(path) as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                d = yaml.safe_load(f)
            else:
                d = json.load(f)
        rules = d["rules"]
    except Exception:
        if fallback is None:
            raise
        return fallback
    on = [TIE_BREAKERS[k] for k in TIE_BREAKERS if (d.get("tie_breakers") or {}).get(k)]
    return Rules(
        {k: v.get("title") or [] for k, v in rules.items()}, {k: v.get("tech_slugs") or [] for k, v in rules.items()},
        tuple(d.get("categories", rules)), {**Rules({}).weights, **(d.get("weights") or {})}, float(d.get("min_score", 1.0)),
        overrides=tuple(t["override"] for t in on if "override" in t), bonuses=tuple(t["bonus"] for t in on if "bonus" in t), lone_bonuses=tuple(p for p in PROMOTED if p[0] in rules),
    )


def has_keyword(text: Column, keyword: str) -> Column:
    """Whether a lower-case text holds the keyword: anywhere, or, for keywords with blanks at the ends, as a word."""
    word = keyword.strip()
    inside = text.contains(keyword)
    if word == keyword or not word:
        return inside
    # the cheap test first: most texts don't hold the word at all
    return inside | (text.contains(word) & text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])\Q{word}\E($|[^\p{{L}}\p{{N}}_])"))


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords a text holds; 0 for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for k in keywords:
        out = out + has_keyword(t, k).cast("int")
    return out


def raw_scores(rules: Rules, title: Column, normalized: Column | None = None, slugs: Column | None = None, description: Column | None = None) -> dict[str, Column]:
    """The score of each category before bonuses. Without a normalised title the title counts in its place."""
    w = rules.weights
    out = {}
    for name in rules.order or tuple(rules.titles):
        if name == rules.other or name not in rules.titles:
            continue
        words = rules.titles[name]
        if normalized is None:
            total = F.lit(w["title"] + w["normalized_title"]) * hits(title, words)
        else:
            total = F.lit(w["title"]) * hits(title, words) + F.lit(w["normalized_title"]) * hits(normalized, words)
        if slugs is not None and rules.slugs.get(name):
            common = F.size(F.array_intersect(F.transform(F.coalesce(slugs, F.array().cast("array<string>")), F.lower), F.array(*[F.lit(s.lower()) for s in rules.slugs[name]])))
            total = total + F.lit(w["tech_slugs"]) * common
        if description is not None:
            total = total + F.lit(w["description"]) * hits(description, words)
        out[name] = total
    return out


def choose(rules: Rules, scores: dict[str, Column], title: Column, normalized: Column | None = None) -> Column:
    """The category with the highest score after bonuses, the earlier one of equals; below the least score, and for empty rules, the other category."""
    if not scores:
        return F.lit(rules.other)
    got = dict(scores)
    for better, than, extra in rules.bonuses:
        if better in got and than in got:
            got[better] = got[better] + F.when((scores[better] > 0) & (scores[than] > 0), extra).otherwise(0.0)
    both_titles = F.concat_ws(" ", title, normalized) if normalized is not None else title
    for name, extra in rules.lone_bonuses:
        if name in got:
            got[name] = got[name] + F.when(hits(both_titles, rules.titles.get(name, [])) > 0, extra).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("c")) for i, (name, s) in enumerate(got.items())]))
    out = F.when(best["s"] >= rules.least, best["c"]).otherwise(rules.other)
    both = F.lower(F.concat_ws(" ", title, normalized)) if normalized is not None else F.lower(F.coalesce(title, F.lit("")))
    for pattern, name in reversed(rules.overrides):
        out = F.when(both.rlike(pattern), name).otherwise(out)
    return out


def classify(rules: Rules, title: Column, normalized: Column | None = None, slugs: Column | None = None, description: Column | None = None) -> Column:
    """The category of a row as one expression; for whole tables ``classified`` computes each score once."""
    return choose(rules, raw_scores(rules, title, normalized, slugs, description), title, normalized)


def classified(df: DataFrame, rules: Rules, title: Column, normalized: Column | None = None, slugs: Column | None = None, description: Column | None = None, name: str = "category") -> DataFrame:
    """``df`` with its category in the column ``name``. Columns of ``df`` named __score0, __score1 ... are not kept."""
    scores = raw_scores(rules, title, normalized, slugs, description)
    held = {f"__score{k}": s for k, s in enumerate(scores.values())}
    again = {n: F.col(f"__score{k}") for k, n in enumerate(scores)}
    return df.withColumns(held).withColumn(name, choose(rules, again, title, normalized)).drop(*held) if held else df.withColumn(name, F.lit(rules.other))
