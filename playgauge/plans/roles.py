"""The declared tables, derived from the star-schema test tables.

Each role is a projection (and at most a small dimension join) of one source
table, so scans keep their column pruning and filter pushdown.

Faults and corner cases are planted in them, so that the checks can fail: references
to parents that don't exist, repeated keys, missing and zero powers, several goal
versions inside the analysis window, and versions that begin on one day.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("easy", "normal", "hard", "mythic")

# Declared, so that opening a table starts no job to read its schema.
SOURCES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

NAMES = (
    "accounts",
    "characters",
    "daily_activity",
    "content_master",
    "content_design_goals",
    "content_attempts",
    "boss_pattern_logs",
    "reward_logs",
    "enhancement_logs",
    "payments",
)


def _by_tier(*values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE n_nationkey % 4 {cases} END"

GOAL_VERSIONS = "k < 2 OR k = 2 AND n_nationkey % 3 = 0 OR k = 3 AND n_nationkey % 6 = 0 OR k = 4 AND n_nationkey % 5 = 0"


class Roles(Mapping[str, DataFrame]):
    """Role views of one data folder by table name, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def source(self, name: str) -> DataFrame:
        return self._spark.read.schema(SOURCES[name]).parquet(f"{self._folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in NAMES:
            return getattr(self, name)
        if name in SOURCES:
            return self.source(name)
        raise KeyError(name)

    def __iter__(self) -> Iterator[str]:
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)

    @cached_property
    def accounts(self) -> DataFrame:
        return self.source("customer").selectExpr(
            "c_custkey AS account_id",
            "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 700 AS INT)) AS created_at",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 'active' ELSE lower(c_mktsegment) END AS account_status",
            "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS platform",
            "CAST(c_custkey % 10 = 0 AS INT) AS is_tester",
        )

    @cached_property
    def characters(self) -> DataFrame:
        return self.source("customer").selectExpr(
            "c_custkey AS character_id",
            "CASE WHEN c_custkey % 71 = 3 THEN c_custkey + 100000000 ELSE c_custkey DIV 2 END AS account_id",
            "c_name AS character_name",
            "c_mktsegment AS class_name",
            "timestamp_ntz'1995-02-01 00:00:00' + make_dt_interval(CAST(c_custkey % 900 AS INT)) AS created_at",
            "CAST(c_custkey % 100 AS INT) AS level",
            "CAST(CASE WHEN c_custkey % 43 <> 7 THEN c_acctbal END AS DECIMAL(12,2)) AS combat_power",
            "CAST(c_nationkey * 10 + c_custkey % 10 AS INT) AS gear_score",
            "CAST(c_acctbal < 0 AS INT) AS is_deleted",
        )

    @cached_property
    def content_master(self) -> DataFrame:
        joined = self.source("nation").join(
            self.source("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return joined.selectExpr(
            "CAST(n_nationkey AS BIGINT) AS content_id",
            f"concat(r_name, ' ', initcap({_by_tier(*map(repr, TIERS))})) AS content_name",
            "r_name AS content_type",
            f"{_by_tier(*map(repr, TIERS))} AS difficulty",
            "CAST(3 * n_nationkey AS INT) AS required_level",
            "CAST(CASE WHEN n_nationkey = 5 THEN 0 ELSE 1000 + 300 * n_nationkey END AS BIGINT) AS recommended_combat_power",
            "1 AS min_party_size",
            "4 AS max_party_size",
            "CASE WHEN n_nationkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS entry_limit_type",
            "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 4 + 1 END AS entry_limit_count",
            "CAST(600 + 60 * n_nationkey AS INT) AS expected_clear_time_sec",
            "date_add(DATE'1994-06-01', CAST(90 * n_nationkey AS INT)) AS release_date",
            "CAST(n_nationkey <> 7 AS INT) AS is_active",
        )

    @cached_property
    def content_design_goals(self) -> DataFrame:
        # Two versions each; one or two inside the window of 1996 for every third content, the two on one day;
        # for every fifth, two newest ones.
        versions = self.source("nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter(GOAL_VERSIONS)
        return versions.selectExpr(
            "CAST(5 * n_nationkey + k AS BIGINT) AS goal_id",
            "CAST(n_nationkey AS BIGINT) AS content_id",
            f"{_by_tier(*map(repr, TIERS))} AS difficulty",
            "concat('S', k) AS season_id",
            f"CAST({_by_tier('45', '31', '20', '12')} AS DECIMAL(5,2)) AS target_participation_rate",
            f"CAST({_by_tier('40', '34', '33', '30')} - 2 * k AS DECIMAL(5,2)) AS target_clear_rate",
            f"{_by_tier('1500', '2000', '2500', '3000')} + 10 * k AS target_avg_clear_time_sec",
            f"CAST({_by_tier('18', '24', '30', '36')} AS DECIMAL(5,2)) AS target_retry_rate",
            f"CAST({_by_tier('0.5', '1.5', '2.5', '4.5')} AS DECIMAL(5,2)) AS target_death_count_avg",
            f"CAST({_by_tier('12000', '24000', '36000', '48000')} AS BIGINT) AS target_reward_value",
            "CASE k WHEN 0 THEN DATE'1995-01-01' WHEN 2 THEN DATE'1996-06-01' WHEN 3 THEN DATE'1996-06-01'"
            " ELSE DATE'1998-01-01' END AS valid_from",
            "CASE k WHEN 0 THEN DATE'1997-12-31' END AS valid_to",
        )

    @cached_property
    def content_attempts(self) -> DataFrame:
        return self.source("orders").selectExpr(
            "o_orderkey AS attempt_id",
            "CASE WHEN o_orderkey % 83 = 2 THEN -o_custkey ELSE o_custkey DIV 2 END AS account_id",
            "CASE WHEN o_orderkey % 89 = 1 THEN -o_custkey ELSE o_custkey END AS character_id",
            "CASE WHEN o_orderkey % 97 = 0 THEN 90 + o_orderkey % 3 ELSE o_orderkey % 23 END AS content_id",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey DIV 4 END AS party_id",
            "o_orderdate AS attempt_started_at",
            "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL"
            " ELSE o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 1800 - 60) END AS attempt_ended_at",
            "CASE o_orderkey % 23 % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'normal' WHEN 2 THEN 'hard'"
            " ELSE 'mythic' END AS difficulty",
            "CASE WHEN o_orderstatus = 'F' THEN 'clear' WHEN o_orderstatus = 'O' THEN 'fail'"
            " WHEN o_orderpriority = '1-URGENT' THEN 'disconnect' ELSE 'give_up' END AS result",
            "CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"
            " THEN CAST(floor(o_totalprice / 100) AS INT) END AS clear_time_sec",
            "CAST(o_orderkey % 7 AS INT) AS death_count",
            "CAST(o_orderkey % 3 AS INT) AS revive_count",
            "CAST(o_orderkey % 11 AS INT) AS potion_used_count",
            "CAST(1 + o_orderkey % 4 AS INT) AS party_member_count",
            "CAST(o_orderstatus = 'F' AND o_orderkey % 10 <> 0 AS INT) AS reward_claimed",
        )

    @cached_property
    def attempt_lines(self) -> DataFrame:
        """Attempts as lines of a CSV file, with fields that don't meet the declaration here and there."""
        fields = [
            "concat(IF(o_orderkey % 101 = 3, 'x', ''), o_orderkey)",
            "IF(o_orderkey % 103 = 5, '', CAST(o_custkey DIV 2 AS STRING))",
            "o_custkey",
            "o_orderkey % 23",
            "IF(o_orderkey % 4 = 0, '', CAST(o_orderkey DIV 4 AS STRING))",
            "IF(o_orderkey % 113 = 13, '1996-02-30 00:00:00', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'))",
            "''",
            "'hard'",
            "IF(o_orderkey % 107 = 7, repeat('r', 21), 'fail')",
            "o_orderkey % 900",
            "IF(o_orderkey % 127 = 17, '\"wiped, twice\"', '')",
            *(f"o_orderkey % {n}" for n in (7, 3, 11, 4)),
        ]
        line = ", ',', ".join(f"CAST({f} AS STRING)" for f in fields)
        ending = "CASE WHEN o_orderkey % 131 = 19 THEN '' WHEN o_orderkey % 109 = 11 THEN ',,1,more' ELSE ',,1' END"
        return self.source("orders").selectExpr(f"concat({line}, {ending}) AS value")

    @cached_property
    def boss_pattern_logs(self) -> DataFrame:
        return self.source("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS pattern_log_id",
            "CASE WHEN l_orderkey % 79 = 4 THEN -l_orderkey ELSE l_orderkey END AS attempt_id",
            "l_orderkey % 23 AS content_id",
            "l_linenumber AS phase_no",
            "l_returnflag AS pattern_code",
            "concat('Pattern ', l_returnflag) AS pattern_name",
            "l_shipdate AS pattern_started_at",
            "CAST(l_linestatus = 'F' AS INT) AS was_hit",
            "CAST(l_extendedprice AS DECIMAL(14,2)) AS damage_taken",
            "CAST(l_linestatus = 'F' AND CAST(l_discount AS DECIMAL(4,2)) >= 0.08 AS INT) AS is_fatal",
        )

    @cached_property
    def reward_logs(self) -> DataFrame:
        return self.source("lineitem").selectExpr(
            "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 73 = 5 THEN -l_orderkey ELSE l_orderkey END AS attempt_id",
            "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey % 23 END AS content_id",
            "l_shipdate AS rewarded_at",
            "CASE l_returnflag WHEN 'R' THEN 'content_clear' WHEN 'A' THEN 'drop' ELSE 'event' END AS reward_source",
            "CAST(l_quantity AS INT) AS quantity",
            "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END"
            " AS estimated_gold_value",
        )

    @cached_property
    def enhancement_logs(self) -> DataFrame:
        return self.source("part").selectExpr(
            "p_partkey - CAST(p_partkey % 500 = 1 AS INT) AS enhancement_id",
            "timestamp_ntz'1996-03-01 00:00:00' + make_dt_interval(CAST(p_partkey % 1000 AS INT)) AS enhanced_at",
        )

    @cached_property
    def daily_activity(self) -> DataFrame:
        return (
            self.source("events")
            .withColumn("play_minutes", F.expr("CAST(floor(value) AS INT)"))
            .selectExpr(
                "CAST(add_months(CAST(ts AS DATE), -336) AS DATE) AS activity_date",
                "user_id DIV 2 AS account_id",
                "user_id AS character_id",
                "CAST(event_type = 'signup' AS INT) AS login_count",
                "1 AS session_count",
                "play_minutes",
                "CAST(play_minutes DIV 2 AS INT) AS combat_minutes",
                "CAST(play_minutes - play_minutes DIV 2 AS INT) AS non_combat_minutes",
                "CAST(event_type = 'click' AS INT) AS content_attempt_count",
                "CAST(event_type = 'view' AS INT) AS boss_attempt_count",
                "CAST(event_type = 'error' AS INT) AS enhancement_attempt_count",
                "CAST(event_type = 'purchase' AS INT) AS payment_count",
                "event_id % 1000 AS earned_gold",
                "event_id % 700 AS spent_gold",
            )
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.source("events").filter("event_type = 'purchase'").selectExpr(
            "event_id AS payment_id",
            "user_id AS character_id",
            "ts AS paid_at",
            "CASE event_id % 10 WHEN 0 THEN ts - make_dt_interval(1) WHEN 1 THEN ts + make_dt_interval(1) END"
            " AS refund_at",
        )
