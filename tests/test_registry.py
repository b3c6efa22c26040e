"""Every registered query has an oracle; a spread of them is compared on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"

SAMPLE = [
    "most_linked_pages", "extract_structured", "weighted_links", "select_weighted_link", "robots_rules_join",
    "page_results", "seed_union", "host_failure_streak", "capped_sessions", "politeness_schedule",
    "fetch_outcome", "upsert_pages", "backoff_ms", "bloom_seen_filter", "stream_resume", "build_links_table",
]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_keys():
    core = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert core == set(entry.oracle_sql()) - set(entry.LLM_ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    assert check.compare(spark, con, SF, name).startswith("ok")
