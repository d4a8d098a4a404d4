"""Shape of the physical plans: what is scanned, pushed, shuffled and joined."""

import re

import pytest
from physical import plan_of

from playgauge.operators import eligibility, gap, quality, segments, targets, usage
from playgauge.plans.catalog import WINDOW_END, WINDOW_START, registered
from playgauge.plans.roles import Roles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def roles(spark):
    return Roles(spark, FOLDER)


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(registered()[name](spark, FOLDER))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_orphans_are_an_anti_join(roles):
    plan = plan_of(quality.orphans(roles.content_attempts, "character_id", roles.characters, "character_id"))
    assert "LeftAnti" in plan


def test_scans_read_only_what_is_used(roles):
    plan = plan_of(gap.retry_summary(roles.content_attempts, WINDOW_START, WINDOW_END))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_orderdate"}
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_facts_are_grouped_before_characters_join(roles):
    df = segments.power_segments(
        roles.content_attempts, roles.characters, roles.content_master, roles.content_design_goals
    )
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    lines = optimized.splitlines()

    grouped = next(line for line in lines if "Aggregate" in line and "party_member_count" in line and "character_id" in line)
    orders_scan = next(line for line in lines if "o_orderkey" in line and "Relation" in line)
    assert lines.index(grouped) < lines.index(orders_scan)
    customers = next(line for line in lines if "c_custkey" in line and "Relation" in line)
    assert len(grouped) - len(grouped.lstrip(" :+-")) < len(orders_scan) - len(orders_scan.lstrip(" :+-"))
    assert lines.index(customers) > lines.index(orders_scan)


def test_eligibility_shuffles_cells_not_characters(roles):
    df = eligibility.eligible_characters(roles.content_master, roles.characters)
    plan = plan_of(df)
    # The character scan is followed by a partial count before any exchange.
    scan = plan.index("c_custkey") if "c_custkey" in plan else plan.index("c_acctbal")
    above = plan[:scan]
    assert above.rindex("partial_count(1)") > above.rindex("Exchange")


def test_one_shuffle_of_attempts_for_the_gap_summary(roles):
    plan = plan_of(gap.attempt_summary(roles.content_attempts, WINDOW_START, WINDOW_END))
    assert plan.count("Exchange hashpartitioning") == 2  # content and character, then content
    assert "Expand" not in plan


def test_newest_versions_are_cut_before_the_shuffle(roles):
    ties = plan_of(targets.targets_asof(roles.content_design_goals, mode="latest_ties"))
    assert ties.index("WindowGroupLimit") < ties.index("Exchange") < ties.rindex("WindowGroupLimit")
    newest = plan_of(targets.targets_asof(roles.content_design_goals))
    assert "partial_max_by" in newest and "Window" not in newest


def test_distinct_counts_travel_narrow(roles):
    plan = plan_of(usage.usage_facts(roles.content_attempts))
    assert "Expand" not in plan
    ids = [line for line in plan.splitlines() if "Exchange hashpartitioning(content_id" in line]
    assert any("kind" in line and "id" in line for line in ids)


def test_period_is_a_scalar_subquery(roles):
    plan = plan_of(usage.active_population(roles.daily_activity, roles.characters, roles.content_attempts))
    assert "Subquery" in plan and "start_date" in plan
