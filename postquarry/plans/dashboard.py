"""The pipeline from source tables to the combined table, and the results a dashboard shows."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import markup
from ..operators import analytics, tables


def combined(sources: list[DataFrame]) -> DataFrame:
    """The combined table of raw source tables."""
    return tables.combine(sources)


def job_rows(df: DataFrame) -> DataFrame:
    """The columns that filters work on; null as empty text."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("job_category", "team", "role", "company", "title")], F.coalesce("active", F.lit(True)).alias("active"))


def display_rows(df: DataFrame) -> DataFrame:
    """What a table of jobs shows: date, status, safe link, escaped text, N/A where there is none."""
    show = lambda c: X.escape(F.coalesce(X.filled(F.col(c)), F.lit("N/A")), breaks=True)
    return df.select(
        F.col("id"), *[show(c).alias(c) for c in ("title", "company", "role", "team", "job_category")], X.show_date(F.col("posting_date")).alias("posted"),
        F.when(F.coalesce("active", F.lit(True)), "Active").otherwise("Inactive").alias("status"), X.safe_url(F.coalesce(F.col("url"), F.lit(""))).alias("link"),
    )


def dashboard(df: DataFrame, page: int = 1, size: int = 10, **filters) -> dict[str, DataFrame]:
    """Named results over one filtered base; facets ignore the choice of companies."""
    base = analytics.search(df, **filters)
    skills = analytics.skill_counts(base, markup.qualifications(F.col("basic_qual")), markup.qualifications(F.col("pref_qual")))
    levels = ("job_category", "company", "role")
    return {
        "kpis": analytics.kpis(base),
        "filters": analytics.distinct_values(df, ("job_category", "role", "team")),
        "categories": analytics.category_counts(base),
        "companies": analytics.facet_counts(df, **filters),
        "skills": analytics.page(skills, page, size, F.desc("total_count"), F.col("skill")),
        "links": analytics.flow_links(base, levels),
        "nodes": analytics.flow_nodes(base, levels),
        "rows": display_rows(base),
    }


def as_json(results: dict[str, DataFrame], most: int = 1000) -> dict[str, str]:
    """Each (small) result as a JSON array, safe inside a script; a result of more than ``most`` rows raises an error."""
    out = {}
    for name, df in results.items():
        rows = df.select(X.guarded_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows; show a page of it")
        out[name] = "[" + ",".join(r["j"] for r in rows) + "]"
    return out


def html_table(df: DataFrame, most: int = 1000) -> str:
    """A (small) result as an HTML table, every cell escaped, null as N/A."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows; show a page of it")
    cell = lambda tag, v: f"<{tag}>{html.escape('N/A' if v is None else str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{''.join(cell('th', c) for c in df.columns)}</tr></thead><tbody>{body}</tbody></table>"


def page_of(results: dict[str, DataFrame], title: str, most: int) -> str:
    """One page: KPIs, every result as a table, and all of them as JSON for scripts."""
    data = as_json(results, most)
    kpis = "".join(f"<li><b>{html.escape(k)}</b> {v}</li>" for k, v in results["kpis"].first().asDict().items()) if "kpis" in results else ""
    sections = "".join(f"<section id={html.escape(json.dumps(k))}><h2>{html.escape(k)}</h2>{html_table(df, most)}</section>" for k, df in results.items() if k != "kpis")
    script = f"<script>const results = {{{', '.join(f'{json.dumps(k)}: {v}' for k, v in data.items())}}};</script>"
    return f"<main id=dashboard><h1>{html.escape(title)}</h1><ul class=kpis>{kpis}</ul>{sections}</main>{script}"


def write_html(results: dict[str, DataFrame], path: str, title: str = "Jobs", most: int = 1000) -> None:
    """The results as one page; a page that says what went wrong if they can't be made."""
    try:
        body = page_of(results, title, most)
    except Exception as x:
        body = f"<p class=error>{html.escape(str(x).splitlines()[0][:500])}</p>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{body}")
