"""Queries of the training-data problems and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkflow.llm import abuse, boilerplate, encoding, mixing, packing, repeats, seen, spam
from linkflow.llm.pages import html_pages
from linkflow.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Query name to function of session and data folder; the whole tables are read."""
    return {
        "p1_found": lambda s, d: boilerplate.articles(table(s, d, "crawl_uris")),
        "p1_texts": lambda s, d: boilerplate.article_texts(html_pages(table(s, d, "crawl_uris"))),
        "p3_found": lambda s, d: encoding.damaged_fields(table(s, d, "crawl_uris")),
        "p3_repaired": lambda s, d: encoding.repair(table(s, d, "crawl_uris")),
        "p5_found": lambda s, d: spam.spam_pages(table(s, d, "crawl_uris")),
        "p5_scores": lambda s, d: spam.score_spam(html_pages(table(s, d, "crawl_uris"))),
        "p6_found": lambda s, d: repeats.repeated_lines_of_crawl(table(s, d, "crawl_uris")),
        "p6_templates": lambda s, d: repeats.templates(html_pages(table(s, d, "crawl_uris"))),
        "p6_cleaned": lambda s, d: repeats.without_repeats(table(s, d, "crawl_uris")),
        "p7_found": lambda s, d: seen.known_records(table(s, d, "crawl_uris"), table(s, d, "queue"), "url", "fetch_id", "fetch_id"),
        "p7_error_rate": lambda s, d: seen.error_rate(table(s, d, "crawl_uris"), table(s, d, "queue"), "url", "fetch_id", "fetch_id"),
        "p8_pack": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "container_specs")),
        "p8_fill": lambda s, d: packing.fill_rates(table(s, d, "documents"), table(s, d, "container_specs")),
        "p9_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "source_targets")),
        "p9_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "source_targets")),
        "p10_found": lambda s, d: abuse.abusive_documents(table(s, d, "documents")),
        "p10_scores": lambda s, d: abuse.score_documents(table(s, d, "documents")),
        "p10_rates": lambda s, d: abuse.rates(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {
        "p7_found": """
            SELECT fetch_id FROM (SELECT fetch_id, url, min(fetch_id) OVER (PARTITION BY url) AS first_id FROM crawl_uris)
            WHERE fetch_id > first_id OR url IN (SELECT url FROM queue WHERE url IS NOT NULL)""",
    }
