"""SQL restatements of the registered queries, for DuckDB over the same tables.

They are written plainly, row by row, without the rewrites of the operators, so
that agreement means something. Rounding goes through DECIMAL on both sides.
"""

from __future__ import annotations

from playgauge.plans.catalog import (
    FOCUS_CONTENT,
    FOCUS_LINE,
    FOCUS_PATTERN,
    FOCUS_TIER,
    LOOKUP_IDS,
    PLAY_MINUTES_CAP,
    WINDOW_END,
    WINDOW_START,
)
from playgauge.sources.schemas import TABLES

_TIER = "CASE n_nationkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'normal' WHEN 2 THEN 'hard' ELSE 'mythic' END"
_TIER_TITLE = "CASE n_nationkey % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Hard' ELSE 'Mythic' END"


def _tiered(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE n_nationkey % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END)"


_VERSIONS = """(SELECT * FROM nation, (VALUES (0), (1), (2), (3), (4)) v(k)
    WHERE k < 2 OR (k = 2 AND n_nationkey % 3 = 0) OR (k = 3 AND n_nationkey % 6 = 0) OR (k = 4 AND n_nationkey % 5 = 0))"""

_ROLES = {
    "accounts": """
        SELECT c_custkey AS account_id,
               TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS created_at,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'active' ELSE lower(c_mktsegment) END AS account_status,
               CASE WHEN c_acctbal >= 0 THEN c_name END AS platform,
               CAST(c_custkey % 10 = 0 AS INTEGER) AS is_tester
        FROM customer""",
    "characters": """
        SELECT c_custkey AS character_id, IF(c_custkey % 71 = 3, c_custkey + 100000000, c_custkey // 2) AS account_id,
               TIMESTAMP '1995-02-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS created_at,
               c_custkey % 100 AS level, CAST(IF(c_custkey % 43 = 7, NULL, c_acctbal) AS DECIMAL(12,2)) AS combat_power,
               c_nationkey * 10 + c_custkey % 10 AS gear_score,
               CAST(c_acctbal < 0 AS INTEGER) AS is_deleted
        FROM customer""",
    "content_master": f"""
        SELECT n_nationkey AS content_id, r_name || ' ' || {_TIER_TITLE} AS content_name,
               r_name AS content_type, {_TIER} AS difficulty, 3 * n_nationkey AS required_level,
               IF(n_nationkey = 5, 0, 1000 + 300 * n_nationkey) AS recommended_combat_power,
               1 AS min_party_size, 4 AS max_party_size,
               CASE n_nationkey % 2 WHEN 0 THEN 'daily' ELSE 'weekly' END AS entry_limit_type,
               CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 4 + 1 END AS entry_limit_count,
               600 + 60 * n_nationkey AS expected_clear_time_sec,
               CAST(DATE '1994-06-01' + 90 * n_nationkey AS DATE) AS release_date,
               CAST(n_nationkey <> 7 AS INTEGER) AS is_active
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "goals": f"""
        SELECT 5 * n_nationkey + k AS goal_id, n_nationkey AS content_id, {_TIER} AS difficulty,
               'S' || k AS season_id,
               CAST({_tiered('45', '31', '20', '12')} AS DECIMAL(5,2)) AS target_participation_rate,
               CAST({_tiered('40', '34', '33', '30')} - 2 * k AS DECIMAL(5,2)) AS target_clear_rate,
               {_tiered('1500', '2000', '2500', '3000')} + 10 * k AS target_avg_clear_time_sec,
               CAST({_tiered('18', '24', '30', '36')} AS DECIMAL(5,2)) AS target_retry_rate,
               CAST({_tiered('0.5', '1.5', '2.5', '4.5')} AS DECIMAL(5,2)) AS target_death_count_avg,
               {_tiered('12000', '24000', '36000', '48000')} AS target_reward_value,
               CASE WHEN k = 0 THEN DATE '1995-01-01' WHEN k IN (2, 3) THEN DATE '1996-06-01' ELSE DATE '1998-01-01' END AS valid_from,
               CASE k WHEN 0 THEN DATE '1997-12-31' END AS valid_to
        FROM {_VERSIONS}""",
    "attempts": """
        SELECT o_orderkey AS attempt_id, IF(o_orderkey % 83 = 2, -o_custkey, o_custkey // 2) AS account_id,
               IF(o_orderkey % 89 = 1, -o_custkey, o_custkey) AS character_id,
               IF(o_orderkey % 97 = 0, 90 + o_orderkey % 3, o_orderkey % 23) AS content_id,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 4 END AS party_id,
               o_orderdate AS attempt_started_at,
               CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT'
                    THEN o_orderdate + to_seconds(o_orderkey % 1800 - 60) END AS attempt_ended_at,
               CASE o_orderstatus WHEN 'F' THEN 'clear' WHEN 'O' THEN 'fail'
                    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'disconnect' ELSE 'give_up' END
               END AS result,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
                    THEN CAST(floor(o_totalprice / 100) AS INTEGER) END AS clear_time_sec,
               o_orderkey % 7 AS death_count, o_orderkey % 3 AS revive_count,
               o_orderkey % 11 AS potion_used_count, 1 + o_orderkey % 4 AS party_member_count,
               CAST(o_orderstatus = 'F' AND o_orderkey % 10 <> 0 AS INTEGER) AS reward_claimed
        FROM orders""",
    "pattern_logs": """
        SELECT IF(l_orderkey % 79 = 4, -l_orderkey, l_orderkey) AS attempt_id, l_orderkey % 23 AS content_id, l_linenumber AS phase_no,
               l_returnflag AS pattern_code, 'Pattern ' || l_returnflag AS pattern_name,
               l_shipdate AS pattern_started_at,
               CAST(l_linestatus = 'F' AS INTEGER) AS was_hit,
               CAST(l_extendedprice AS DECIMAL(14,2)) AS damage_taken,
               CAST(l_linestatus = 'F' AND CAST(l_discount AS DECIMAL(4,2)) >= 0.08 AS INTEGER) AS is_fatal
        FROM lineitem""",
    "reward_logs": """
        SELECT CASE WHEN l_linenumber <> 7 THEN IF(l_orderkey % 73 = 5, -l_orderkey, l_orderkey) END AS attempt_id,
               CASE WHEN l_linenumber <> 6 THEN l_orderkey % 23 END AS content_id,
               l_shipdate AS rewarded_at,
               CASE l_returnflag WHEN 'R' THEN 'content_clear' WHEN 'A' THEN 'drop' ELSE 'event' END AS reward_source,
               CAST(l_quantity AS INTEGER) AS quantity,
               CASE WHEN l_discount <> 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS estimated_gold_value
        FROM lineitem""",
    "enhancements": """
        SELECT IF(p_partkey % 500 = 1, p_partkey - 1, p_partkey) AS enhancement_id,
               TIMESTAMP '1996-03-01' + to_days(CAST(p_partkey % 1000 AS INTEGER)) AS enhanced_at
        FROM part""",
    "activity": """
        SELECT CAST(CAST(ts AS DATE) - INTERVAL 28 YEAR AS DATE) AS activity_date,
               user_id // 2 AS account_id, user_id AS character_id,
               CAST(event_type = 'signup' AS INTEGER) AS login_count, 1 AS session_count,
               CAST(floor(value) AS INTEGER) AS play_minutes,
               CAST(floor(value) AS INTEGER) // 2 AS combat_minutes,
               CAST(floor(value) AS INTEGER) - CAST(floor(value) AS INTEGER) // 2 AS non_combat_minutes,
               CAST(event_type = 'click' AS INTEGER) AS content_attempt_count,
               CAST(event_type = 'view' AS INTEGER) AS boss_attempt_count,
               CAST(event_type = 'error' AS INTEGER) AS enhancement_attempt_count,
               CAST(event_type = 'purchase' AS INTEGER) AS payment_count,
               event_id % 1000 AS earned_gold, event_id % 700 AS spent_gold
        FROM events""",
    "payments": """
        SELECT event_id AS payment_id, user_id AS character_id, ts AS paid_at,
               CASE event_id % 10 WHEN 0 THEN ts - INTERVAL 1 DAY WHEN 1 THEN ts + INTERVAL 1 DAY END AS refund_at
        FROM events WHERE event_type = 'purchase'""",
}


def _with(roles: str, **steps: str) -> str:
    """WITH clause of the named roles and any further steps."""
    parts = [f"{name} AS ({_ROLES[name]})" for name in roles.split()]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def _r(value: str, digits: int = 2) -> str:
    """Rounded half away from zero; eight exact decimals absorb binary noise first."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def _pct(part: str, whole: str) -> str:
    return f"({part}) * 100.0 / NULLIF({whole}, 0)"


def _n(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def _f(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def _day(value: str) -> str:
    return f"CAST(CAST({value} AS DATE) AS VARCHAR)"


def _is(outcome: str) -> str:
    return f"COUNT(*) FILTER (WHERE result = '{outcome}')"


_CLEAR_TIME = "AVG(clear_time_sec) FILTER (WHERE result = 'clear')"
_IN_WINDOW = f"BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}'"
# Goal versions: newest per content, newest that began by the window end, newest with ties.
_NEWEST = "SELECT * FROM goals QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY valid_from DESC, goal_id DESC) = 1"
_NEWEST_BY_END = (
    f"SELECT * FROM goals WHERE valid_from <= DATE '{WINDOW_END}' QUALIFY row_number() OVER"
    " (PARTITION BY content_id, difficulty ORDER BY valid_from DESC, goal_id DESC) = 1"
)
_NEWEST_TIES = (
    "SELECT * FROM goals QUALIFY rank() OVER (PARTITION BY content_id, difficulty ORDER BY valid_from DESC) = 1"
)
_BAND = """CASE WHEN combat_power < recommended_combat_power * 0.8 THEN '01_under_80'
    WHEN combat_power < recommended_combat_power THEN '02_80_to_100'
    WHEN combat_power < recommended_combat_power * 1.1 THEN '03_100_to_110'
    WHEN combat_power < recommended_combat_power * 1.2 THEN '04_110_to_120'
    ELSE '05_120_and_over' END"""
_DURATION = "COALESCE(clear_time_sec, date_diff('second', attempt_started_at, attempt_ended_at))"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- quality


def _load_quarantine() -> str:
    # The faults of the lines, by reason.
    faults = {
        "bad_value:attempt_id": "o_orderkey % 101 = 3",
        "missing:account_id": "o_orderkey % 103 = 5",
        "too_long:result": "o_orderkey % 107 = 7",
        "bad_value:attempt_started_at": "o_orderkey % 113 = 13",
        "malformed_row": "o_orderkey % 109 = 11 OR o_orderkey % 131 = 19",
        "missing:reward_claimed": "o_orderkey % 131 = 19",
    }
    anything = " OR ".join(faults.values())
    labels = [f"SELECT IF({anything}, 'quarantined', 'accepted') AS outcome FROM orders"]
    labels += [f"SELECT '{reason}' FROM orders WHERE {fault}" for reason, fault in faults.items()]
    return f"SELECT 'content_attempts' AS table_name, outcome, COUNT(*) AS \"rows\" FROM ({_union(labels)}) GROUP BY ALL"


def _dq_rules() -> str:
    return _with("activity attempts payments") + _union(
        [
            "SELECT 'invalid_playtime_over_24h' AS rule, COUNT(*) AS violations FROM activity"
            f" WHERE play_minutes > {PLAY_MINUTES_CAP}",
            "SELECT 'invalid_attempt_time_reverse', COUNT(*) FROM attempts WHERE attempt_started_at > attempt_ended_at",
            "SELECT 'invalid_clear_without_clear_time', COUNT(*) FROM attempts"
            " WHERE clear_time_sec IS NULL AND result = 'clear'",
            "SELECT 'invalid_refund_time_reverse', COUNT(*) FROM payments WHERE paid_at > refund_at",
        ]
    )


def _dq_reward_on_failed() -> str:
    return _with("attempts reward_logs") + (
        "SELECT 'invalid_reward_on_failed_attempt' AS rule, COUNT(*) AS violations FROM reward_logs"
        " JOIN attempts USING (attempt_id) WHERE reward_source = 'content_clear' AND result IN ('give_up', 'fail')"
    )


def _dq_orphan_multi_parent() -> str:
    return _with("activity accounts characters") + (
        "SELECT COUNT(*) AS orphan_rows FROM activity WHERE account_id NOT IN (SELECT account_id FROM accounts)"
        " OR character_id NOT IN (SELECT character_id FROM characters)"
        " OR character_id NOT IN (SELECT s_suppkey FROM supplier)"
    )


def _dq_fk_summary() -> str:
    def one(label: str, child: str, column: str, parent: str, key: str) -> str:
        return (
            f"SELECT '{label}' AS fk, COUNT(*) AS orphan_rows FROM {child} c WHERE c.{column} IS NOT NULL"
            f" AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"
        )

    return _with("accounts characters attempts content_master pattern_logs reward_logs") + _union(
        [
            one("characters.account_id->accounts.account_id", "characters", "account_id", "accounts", "account_id"),
            one(
                "content_attempts.character_id->characters.character_id",
                "attempts",
                "character_id",
                "characters",
                "character_id",
            ),
            one(
                "content_attempts.content_id->content_master.content_id",
                "attempts",
                "content_id",
                "content_master",
                "content_id",
            ),
            one(
                "boss_pattern_logs.attempt_id->content_attempts.attempt_id",
                "pattern_logs",
                "attempt_id",
                "attempts",
                "attempt_id",
            ),
            one(
                "reward_logs.attempt_id->content_attempts.attempt_id",
                "reward_logs",
                "attempt_id",
                "attempts",
                "attempt_id",
            ),
            one("events.user_id->supplier.s_suppkey", "events", "user_id", "supplier", "s_suppkey"),
        ]
    )


def _dq_null_profile() -> str:
    # column, required, length limit
    layout = {
        ("accounts", "accounts"): [
            ("account_id", True, None),
            ("created_at", True, None),
            ("platform", True, 20),
            ("account_status", True, 20),
            ("is_tester", True, None),
        ],
        ("content_attempts", "attempts"): [
            ("attempt_id", True, None),
            ("account_id", True, None),
            ("character_id", True, None),
            ("content_id", True, None),
            ("party_id", False, None),
            ("attempt_started_at", True, None),
            ("attempt_ended_at", False, None),
            ("difficulty", True, 20),
            ("result", True, 20),
            ("clear_time_sec", False, None),
            ("death_count", True, None),
            ("revive_count", True, None),
            ("potion_used_count", True, None),
            ("party_member_count", True, None),
            ("reward_claimed", True, None),
        ],
        ("reward_logs", "reward_logs"): [
            ("attempt_id", False, None),
            ("content_id", False, None),
            ("rewarded_at", True, None),
            ("reward_source", True, 30),
            ("quantity", True, None),
            ("estimated_gold_value", False, None),
        ],
    }
    # Declared columns that the views lack count as NULL in every row: column, required.
    absent = {
        "accounts": [("last_login_at", False), ("signup_channel", True), ("country_code", True), ("marketing_opt_in", False)],
        "content_attempts": [("fail_reason", False), ("avg_party_combat_power", False)],
        "reward_logs": [
            ("reward_id", True), ("account_id", True), ("character_id", True), ("item_id", True),
            ("item_name", True), ("item_type", True), ("item_rarity", True), ("is_first_clear_reward", True),
        ],
    }
    lines = []
    for (table, view), columns in layout.items():
        for column, required in absent[table]:
            lines.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, COUNT(*) AS row_count, COUNT(*) AS nulls,"
                f" {'COUNT(*)' if required else 'CAST(0 AS BIGINT)'} AS null_violations,"
                f" CAST(0 AS BIGINT) AS over_length FROM {view}"
            )
        for column, required, limit in columns:
            if (table, column) == ("content_attempts", "difficulty"):  # which this view doesn't carry
                column_sql = "CASE content_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'normal' WHEN 2 THEN 'hard' ELSE 'mythic' END"
            else:
                column_sql = column
            nulls = f"COUNT(*) FILTER (WHERE {column_sql} IS NULL)"
            long = f"COUNT(*) FILTER (WHERE length({column_sql}) > {limit})" if limit else "CAST(0 AS BIGINT)"
            lines.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, COUNT(*) AS row_count, {nulls} AS nulls,"
                f" {nulls if required else 'CAST(0 AS BIGINT)'} AS null_violations, {long} AS over_length FROM {view}"
            )
    return _with("accounts attempts reward_logs") + _union(lines)


# What each declared column of the other views is made of, as far as NULLs and lengths go.
_MADE_OF = {
    "characters": ("customer", {
        "character_id": "c_custkey", "account_id": "c_custkey", "character_name": "c_name", "class_name": "c_mktsegment",
        "created_at": "c_custkey", "level": "c_custkey", "combat_power": "IF(c_custkey % 43 = 7, NULL, c_acctbal)",
        "gear_score": "c_nationkey + c_custkey", "is_deleted": "c_acctbal",
    }),
    "content_master": ("nation JOIN region ON r_regionkey = n_regionkey", {
        "content_id": "n_nationkey", "content_type": "r_name", "difficulty": "'mythic'",
        "content_name": f"r_name || ' ' || {_TIER_TITLE}",
        "required_level": "n_nationkey", "recommended_combat_power": "n_nationkey", "min_party_size": "1", "max_party_size": "4",
        "entry_limit_type": "'weekly'", "entry_limit_count": "CASE WHEN n_nationkey % 5 > 0 THEN 1 END",
        "expected_clear_time_sec": "n_nationkey", "release_date": "n_nationkey", "is_active": "n_nationkey",
    }),
    "content_design_goals": (_VERSIONS, {
        **dict.fromkeys((
            "goal_id", "content_id", "target_participation_rate", "target_clear_rate", "target_avg_clear_time_sec",
            "target_retry_rate", "target_death_count_avg", "target_reward_value", "valid_from",
        ), "n_nationkey"),
        "difficulty": "'mythic'", "season_id": "'S0'", "valid_to": "CASE k WHEN 0 THEN 1 END",
    }),
    "daily_activity": ("events", {
        "activity_date": "ts", "account_id": "user_id", "character_id": "user_id", "login_count": "event_type", "session_count": "1",
        "play_minutes": "value", "combat_minutes": "value", "non_combat_minutes": "value",
        "content_attempt_count": "event_type", "boss_attempt_count": "event_type", "enhancement_attempt_count": "event_type",
        "payment_count": "event_type", "earned_gold": "event_id", "spent_gold": "event_id",
    }),
    "boss_pattern_logs": ("lineitem", {
        "pattern_log_id": "l_orderkey + l_linenumber", "attempt_id": "l_orderkey", "content_id": "l_orderkey", "phase_no": "l_linenumber",
        "pattern_code": "l_returnflag", "pattern_name": "'Pattern ' || l_returnflag", "pattern_started_at": "l_shipdate",
        "was_hit": "l_linestatus", "damage_taken": "l_extendedprice", "is_fatal": "l_discount",
    }),
    "enhancement_logs": ("part", {"enhancement_id": "p_partkey", "enhanced_at": "p_partkey"}),
    "payments": ("(SELECT * FROM events WHERE event_type = 'purchase')", {
        "payment_id": "event_id", "character_id": "user_id", "paid_at": "ts", "refund_at": "CASE WHEN event_id % 10 < 2 THEN ts END",
    }),
}


def _dq_null_profile_all() -> str:
    lines = [f"SELECT * FROM ({_dq_null_profile()})"]
    for table, (source, made_of) in _MADE_OF.items():
        for column in TABLES[table].columns:
            value = made_of.get(column.name, "NULL")
            nulls = f"COUNT(*) FILTER (WHERE ({value}) IS NULL)"
            long = f"COUNT(*) FILTER (WHERE length({value}) > {column.max_length})" if column.max_length else "CAST(0 AS BIGINT)"
            lines.append(
                f"SELECT '{table}' AS table_name, '{column.name}' AS column_name, COUNT(*) AS row_count, {nulls} AS nulls,"
                f" {nulls if column.required else 'CAST(0 AS BIGINT)'} AS null_violations, {long} AS over_length FROM {source}"
            )
    return _union(lines)


def _dq_pk_duplicates_all() -> str:
    keys = {
        "accounts": ("customer", "c_custkey"),
        "characters": ("customer", "c_custkey"),
        "content_master": ("nation JOIN region ON r_regionkey = n_regionkey", "n_nationkey"),
        "content_design_goals": (_VERSIONS, "5 * n_nationkey + k"),
        "content_attempts": ("orders", "o_orderkey"),
        "boss_pattern_logs": ("lineitem", "l_orderkey * 10 + l_linenumber"),
        "enhancement_logs": ("part", "IF(p_partkey % 500 = 1, p_partkey - 1, p_partkey)"),
        "payments": ("(SELECT * FROM events WHERE event_type = 'purchase')", "event_id"),
    }
    return _union(
        [
            f"SELECT '{table}' AS table_name, COALESCE(CAST({key} AS VARCHAR), 'NULL') AS key_value, COUNT(*) AS n"
            f" FROM {source} GROUP BY ALL HAVING COUNT(*) > 1"
            for table, (source, key) in keys.items()
        ]
        # a view without the key
        + ["SELECT 'reward_logs', 'absent: reward_id', CAST(NULL AS BIGINT)"]
    )


def _dq_fk_orphans_all() -> str:
    def one(table: str, view: str, column: str, parent: str, parent_view: str, kept: str = "true") -> str:
        return (
            f"SELECT '{table}.{column}->{parent}.{column}' AS fk, CAST({column} AS BIGINT) AS orphan_key, COUNT(*) AS orphan_rows"
            f" FROM {view} c WHERE {kept} AND NOT EXISTS (SELECT 1 FROM {parent_view} p WHERE p.{column} = c.{column}) GROUP BY ALL"
        )

    return _with("accounts characters attempts content_master pattern_logs reward_logs") + _union(
        [
            one("characters", "characters", "account_id", "accounts", "accounts"),
            one("content_attempts", "attempts", "character_id", "characters", "characters"),
            one("content_attempts", "attempts", "content_id", "content_master", "content_master"),
            one("boss_pattern_logs", "pattern_logs", "attempt_id", "content_attempts", "attempts"),
            one("reward_logs", "reward_logs", "attempt_id", "content_attempts", "attempts", "attempt_id IS NOT NULL"),
        ]
    )


def _dq_orphan_attempts() -> str:
    return _with("accounts characters attempts content_master") + (
        "SELECT COUNT(*) AS orphan_rows FROM attempts a"
        " WHERE NOT EXISTS (SELECT 1 FROM accounts p WHERE p.account_id = a.account_id)"
        " OR NOT EXISTS (SELECT 1 FROM characters p WHERE p.character_id = a.character_id)"
        " OR NOT EXISTS (SELECT 1 FROM content_master p WHERE p.content_id = a.content_id)"
    )


# ---------------------------------------------------------------- profiles

_NAMES = {
    "accounts": "accounts",
    "characters": "characters",
    "daily_activity": "activity",
    "content_master": "content_master",
    "content_design_goals": "goals",
    "content_attempts": "attempts",
    "boss_pattern_logs": "pattern_logs",
    "reward_logs": "reward_logs",
    "enhancement_logs": "enhancements",
    "payments": "payments",
}


def _table_row_counts() -> str:
    return _with(" ".join(_NAMES.values())) + _union(
        [f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {view}" for name, view in _NAMES.items()]
    )


def _date_spans() -> str:
    columns = {
        "accounts": "created_at",
        "characters": "created_at",
        "daily_activity": "activity_date",
        "content_attempts": "attempt_started_at",
        "boss_pattern_logs": "pattern_started_at",
        "reward_logs": "rewarded_at",
        "enhancement_logs": "enhanced_at",
        "payments": "paid_at",
    }
    return _with(" ".join(_NAMES[t] for t in columns)) + _union(
        [
            f"SELECT '{t}.{c}' AS date_source, {_day(f'MIN({c})')} AS min_date, {_day(f'MAX({c})')} AS max_date,"
            f" 1 + date_diff('day', CAST(MIN({c}) AS DATE), CAST(MAX({c}) AS DATE)) AS date_span_days,"
            f" COUNT(*) AS row_count FROM {_NAMES[t]}"
            for t, c in columns.items()
        ]
    )


def _population_summary() -> str:
    def accounts_where(condition: str) -> str:
        return f"COUNT(DISTINCT a.account_id) FILTER (WHERE {condition})"

    def characters_where(condition: str) -> str:
        return f"COUNT(DISTINCT character_id) FILTER (WHERE {condition})"

    live = "FILTER (WHERE is_deleted = 0)"
    per = "COUNT(DISTINCT character_id) * 1.0 / NULLIF(COUNT(DISTINCT a.account_id), 0)"
    return _with("accounts characters") + f"""
        SELECT COUNT(DISTINCT a.account_id) AS total_account_count,
               {accounts_where("account_status = 'active'")} AS active_account_count,
               {accounts_where("account_status <> 'active'")} AS non_active_account_count,
               {accounts_where("is_tester = 1")} AS tester_account_count,
               {accounts_where("is_tester = 0")} AS normal_account_count,
               COUNT(DISTINCT character_id) AS total_character_count,
               {characters_where("is_deleted = 0")} AS active_character_count,
               {characters_where("is_deleted = 1")} AS deleted_character_count,
               {_r(per)} AS avg_character_count_per_account,
               {_r(f"AVG(level) {live}")} AS avg_active_character_level,
               {_r(f"AVG(combat_power) {live}")} AS avg_active_character_combat_power,
               {_r(f"AVG(gear_score) {live}")} AS avg_active_character_gear_score
        FROM accounts a LEFT JOIN characters c ON c.account_id = a.account_id"""


def _daily_kpis() -> str:
    summed = (
        "login_count session_count play_minutes combat_minutes non_combat_minutes content_attempt_count"
        " boss_attempt_count enhancement_attempt_count payment_count earned_gold spent_gold"
    ).split()
    sums = ", ".join(f"{_n(f'SUM({c})')} AS total_{c}" for c in summed)
    return _with("activity") + f"""
        SELECT {_day('activity_date')} AS activity_date, COUNT(DISTINCT account_id) AS dau,
               COUNT(DISTINCT character_id) AS active_character_count, {sums},
               {_r("SUM(play_minutes) * 1.0 / NULLIF(COUNT(DISTINCT account_id), 0)")} AS avg_play_minutes_per_account
        FROM activity GROUP BY activity_date"""


_PEOPLE = (
    "COUNT(DISTINCT account_id) AS participant_account_count,"
    " COUNT(DISTINCT character_id) AS participant_character_count"
)
_EFFORT = ", ".join(f"{_r(f'AVG({c})')} AS avg_{c}" for c in ("death_count", "revive_count", "potion_used_count"))


def _daily_result_distribution() -> str:
    return _with("attempts") + f"""
        SELECT {_day('attempt_started_at')} AS attempt_date, result AS attempt_result, COUNT(*) AS attempt_count,
               {_PEOPLE}, {_r('AVG(clear_time_sec)')} AS avg_clear_time_sec, {_EFFORT}
        FROM attempts GROUP BY 1, 2"""


def _overall_attempt_summary() -> str:
    return _with("attempts") + f"""
        SELECT COUNT(DISTINCT CAST(attempt_started_at AS DATE)) AS date_count,
               {_day('MIN(attempt_started_at)')} AS min_attempt_date,
               {_day('MAX(attempt_started_at)')} AS max_attempt_date, COUNT(*) AS total_attempt_count,
               {_is('clear')} AS clear_attempt_count, {_is('fail')} AS fail_attempt_count,
               {_r(_pct(_is('clear'), 'COUNT(*)'))} AS clear_rate_pct,
               {_r(_pct(_is('fail'), 'COUNT(*)'))} AS fail_rate_pct,
               {_PEOPLE}, {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {_EFFORT}
        FROM attempts"""


def _result_share() -> str:
    return _with("attempts") + f"""
        SELECT result AS attempt_result, COUNT(*) AS attempt_count,
               {_r(_pct('COUNT(*)', '(SELECT COUNT(*) FROM attempts)'))} AS attempt_rate_pct
        FROM attempts GROUP BY result"""


# ---------------------------------------------------------------- health

_HEALTH = f"""
    SELECT content_id, ANY_VALUE(content_name) AS content_name, ANY_VALUE(content_type) AS content_type,
           ANY_VALUE(m.difficulty) AS difficulty, {_n('ANY_VALUE(required_level)')} AS required_level,
           {_n('ANY_VALUE(recommended_combat_power)')} AS recommended_combat_power,
           {_n('ANY_VALUE(min_party_size)')} AS min_party_size, {_n('ANY_VALUE(max_party_size)')} AS max_party_size,
           {_n('ANY_VALUE(expected_clear_time_sec)')} AS expected_clear_time_sec,
           COUNT(*) AS total_attempt_count, {_PEOPLE},
           {", ".join(f"{_is(o)} AS {o}_attempt_count" for o in ('clear', 'fail', 'give_up', 'disconnect'))},
           {", ".join(f"{_r(_pct(_is(o), 'COUNT(*)'))} AS {o}_rate_pct" for o in ('clear', 'fail', 'give_up', 'disconnect'))},
           {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {_EFFORT},
           {_r('AVG(party_member_count)')} AS avg_party_member_count,
           COUNT(*) FILTER (WHERE reward_claimed = 1) AS reward_claimed_count,
           {_r(_pct('COUNT(*) FILTER (WHERE reward_claimed = 1)', 'COUNT(*)'))} AS reward_claimed_rate_pct
    FROM attempts JOIN content_master m USING (content_id) GROUP BY content_id"""


def _content_health() -> str:
    return _with("attempts content_master", health=_HEALTH) + f"SELECT * REPLACE ({_n('content_id')} AS content_id) FROM health"


def _content_health_rollup() -> str:
    spread = ["MIN(clear_rate_pct) AS min_clear_rate_pct"]
    for o in ("clear", "fail", "give_up", "disconnect"):
        spread.append(f"{_r(f'AVG({o}_rate_pct)')} AS avg_{o}_rate_pct, MAX({o}_rate_pct) AS max_{o}_rate_pct")
    again = ("avg_clear_time_sec", "avg_death_count", "avg_revive_count", "avg_potion_used_count")
    return _with("attempts content_master", health=_HEALTH) + f"""
        SELECT COUNT(*) AS content_count, {_n('SUM(total_attempt_count)')} AS total_attempt_count,
               {_r('AVG(total_attempt_count)')} AS avg_attempt_count_per_content,
               MIN(total_attempt_count) AS min_attempt_count, MAX(total_attempt_count) AS max_attempt_count,
               {_r('AVG(participant_account_count)')} AS avg_participant_account_count,
               {_r('AVG(participant_character_count)')} AS avg_participant_character_count,
               {", ".join(spread)}, {", ".join(f"{_r(f'AVG({c})')} AS {c}" for c in again)},
               {_r('AVG(reward_claimed_rate_pct)')} AS avg_reward_claimed_rate_pct
        FROM health"""


def _worst_contents() -> str:
    return _with("attempts content_master", health=_HEALTH) + f"""
        SELECT {_n('content_id')} AS content_id, content_name, content_type, difficulty, total_attempt_count,
               participant_account_count, clear_rate_pct, fail_rate_pct, give_up_rate_pct, disconnect_rate_pct,
               avg_clear_time_sec, avg_death_count, avg_potion_used_count, reward_claimed_rate_pct
        FROM health ORDER BY clear_rate_pct, fail_rate_pct DESC, give_up_rate_pct DESC, content_id LIMIT 10"""


# ---------------------------------------------------------------- goal gap

_ELIGIBLE_ACTIVE = f"""
    SELECT m.content_id, COUNT(DISTINCT character_id) AS eligible_character_count,
           COUNT(DISTINCT character_id) FILTER (WHERE combat_power >= recommended_combat_power)
               AS recommended_ready_character_count
    FROM content_master m LEFT JOIN (
        SELECT * FROM characters WHERE is_deleted = 0
        AND character_id IN (SELECT character_id FROM activity WHERE activity_date {_IN_WINDOW})
    ) c ON c.level >= m.required_level
    WHERE m.is_active = 1 GROUP BY m.content_id"""
_RETRY = f"""
    SELECT content_id, COUNT(character_id) FILTER (WHERE tries > 1) AS retry_character_count
    FROM (SELECT content_id, character_id, COUNT(*) AS tries FROM attempts
          WHERE CAST(attempt_started_at AS DATE) {_IN_WINDOW} GROUP BY ALL)
    GROUP BY content_id"""


def _active_characters() -> str:
    return _with("characters activity") + f"""
        SELECT character_id, account_id, {_n('level')} AS level, {_f('combat_power')} AS combat_power
        FROM characters WHERE is_deleted = 0 AND EXISTS (
            SELECT 1 FROM activity a WHERE a.character_id = characters.character_id AND activity_date {_IN_WINDOW})"""


def _attempt_summary() -> str:
    averages = ", ".join(
        f"{_r(f'AVG({c})')} AS avg_{c}"
        for c in ("death_count", "revive_count", "potion_used_count", "party_member_count")
    )
    return _with("attempts", retry=_RETRY) + f"""
        SELECT content_id, COUNT(*) AS total_attempt_count,
               COUNT(DISTINCT character_id) AS participant_character_count,
               ANY_VALUE(retry_character_count) AS retry_character_count, {_is('clear')} AS clear_count,
               {_is('fail')} AS fail_count, COUNT(*) FILTER (WHERE reward_claimed = 1) AS reward_claimed_count,
               {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {averages}
        FROM attempts JOIN retry USING (content_id)
        WHERE CAST(attempt_started_at AS DATE) {_IN_WINDOW} GROUP BY content_id"""


def _reward_summary() -> str:
    return _with("reward_logs") + f"""
        SELECT content_id, COUNT(*) AS reward_log_count, {_r('AVG(estimated_gold_value)')} AS avg_reward_value,
               {_f('SUM(estimated_gold_value)')} AS total_reward_value
        FROM reward_logs WHERE CAST(rewarded_at AS DATE) {_IN_WINDOW} GROUP BY content_id"""


def _eligible_by_content() -> str:
    return _with("characters activity content_master", eligible=_ELIGIBLE_ACTIVE) + (
        f"SELECT * REPLACE ({_n('content_id')} AS content_id) FROM eligible"
    )


def _retry_summary() -> str:
    return _with("attempts", retry=_RETRY) + "SELECT * FROM retry"


def _content_health_gap(targets: str) -> str:
    tried = f"""
        SELECT content_id, COUNT(*) AS total, COUNT(DISTINCT character_id) AS people, {_is('clear')} AS clears,
               {_is('fail')} AS fails, COUNT(*) FILTER (WHERE reward_claimed = 1) AS claimed,
               {_CLEAR_TIME} AS clear_time, AVG(death_count) AS deaths, AVG(revive_count) AS revives,
               AVG(potion_used_count) AS potions, AVG(party_member_count) AS party
        FROM attempts WHERE CAST(attempt_started_at AS DATE) {_IN_WINDOW} GROUP BY content_id"""
    paid = f"""
        SELECT content_id, AVG(estimated_gold_value) AS reward_value FROM reward_logs
        WHERE CAST(rewarded_at AS DATE) {_IN_WINDOW} GROUP BY content_id"""
    part = f"CAST({_pct('COALESCE(people, 0)', 'eligible_character_count')} AS DECIMAL(28,8))"
    clear = f"CAST({_pct('clears', 'total')} AS DECIMAL(28,8))"
    time, deaths = "CAST(clear_time AS DECIMAL(28,8))", "CAST(deaths AS DECIMAL(28,8))"
    return _with(
        "characters activity content_master goals attempts reward_logs",
        eligible=_ELIGIBLE_ACTIVE,
        retry=_RETRY,
        tried=tried,
        paid=paid,
        aim=targets,
    ) + f"""
        SELECT {_n('m.content_id')} AS content_id, content_name, content_type, m.difficulty,
               {_n('required_level')} AS required_level, {_n('recommended_combat_power')} AS recommended_combat_power,
               eligible_character_count, recommended_ready_character_count,
               COALESCE(total, 0) AS total_attempt_count, COALESCE(people, 0) AS participant_character_count,
               {_r(part)} AS participation_rate,
               {_r(_pct('recommended_ready_character_count', 'eligible_character_count'))} AS recommended_ready_rate,
               {_r(clear)} AS clear_rate, {_r(_pct('fails', 'total'))} AS fail_rate,
               {_r(_pct('COALESCE(retry_character_count, 0)', 'people'))} AS retry_rate,
               {_r('clear_time')} AS avg_clear_time_sec, {_r('deaths')} AS avg_death_count,
               {_r('revives')} AS avg_revive_count, {_r('potions')} AS avg_potion_used_count,
               {_r('party')} AS avg_party_member_count, {_r(_pct('claimed', 'clears'))} AS reward_claim_rate,
               {_r('reward_value')} AS avg_reward_value,
               {_f('target_participation_rate')} AS target_participation_rate,
               {_f('target_clear_rate')} AS target_clear_rate,
               {_n('target_avg_clear_time_sec')} AS target_avg_clear_time_sec,
               {_f('target_retry_rate')} AS target_retry_rate,
               {_f('target_death_count_avg')} AS target_death_count_avg,
               {_n('target_reward_value')} AS target_reward_value,
               {_r(f"{part} - target_participation_rate")} AS participation_gap,
               {_r(f"{clear} - target_clear_rate")} AS clear_rate_gap,
               {_r(f"{time} - target_avg_clear_time_sec")} AS clear_time_gap,
               {_r(f"{deaths} - target_death_count_avg")} AS death_count_gap,
               CASE WHEN total IS NULL THEN 'NO_DATA'
                    WHEN {part} < 0.7 * target_participation_rate THEN 'LOW_PARTICIPATION'
                    WHEN {clear} + 15 < target_clear_rate THEN 'LOW_CLEAR_RATE'
                    WHEN {time} > 1.3 * target_avg_clear_time_sec THEN 'LONG_CLEAR_TIME'
                    WHEN {deaths} > 1.5 * target_death_count_avg THEN 'HIGH_DEATH_COUNT'
                    ELSE 'NORMAL' END AS health_status
        FROM content_master m LEFT JOIN eligible e ON e.content_id = m.content_id
        LEFT JOIN tried t ON t.content_id = m.content_id LEFT JOIN retry y ON y.content_id = m.content_id
        LEFT JOIN paid p ON p.content_id = m.content_id
        LEFT JOIN aim a ON a.content_id = m.content_id AND a.difficulty = m.difficulty
        WHERE m.is_active = 1"""


def _target_lookup() -> str:
    ids = ", ".join(map(str, LOOKUP_IDS))
    return _with("content_master goals") + f"""
        SELECT {_n('m.content_id')} AS content_id, content_name, m.difficulty,
               {_f('target_participation_rate')} AS target_participation_rate,
               {_f('target_clear_rate')} AS target_clear_rate,
               {_n('target_avg_clear_time_sec')} AS target_avg_clear_time_sec,
               {_f('target_death_count_avg')} AS target_death_count_avg,
               {_day('valid_from')} AS valid_from, {_day('valid_to')} AS valid_to
        FROM content_master m LEFT JOIN goals g ON g.content_id = m.content_id AND g.difficulty = m.difficulty
        WHERE m.content_id IN ({ids})"""


def _targets_asof() -> str:
    return _with("goals", aim=_NEWEST_BY_END) + f"""
        SELECT {_n('content_id')} AS content_id, difficulty, {_n('goal_id')} AS goal_id, season_id,
               {_f('target_participation_rate')} AS target_participation_rate,
               {_f('target_clear_rate')} AS target_clear_rate,
               {_n('target_avg_clear_time_sec')} AS target_avg_clear_time_sec,
               {_f('target_retry_rate')} AS target_retry_rate,
               {_f('target_death_count_avg')} AS target_death_count_avg,
               {_n('target_reward_value')} AS target_reward_value,
               {_day('valid_from')} AS valid_from, {_day('valid_to')} AS valid_to
        FROM aim"""


# ---------------------------------------------------------------- usage

_POPULATION = """
    SELECT (SELECT COUNT(DISTINCT account_id) FROM played) AS active_account_count,
           (SELECT COUNT(DISTINCT character_id) FROM played JOIN characters USING (character_id)
            WHERE is_deleted = 0) AS active_character_count"""
_PLAYED = """
    SELECT account_id, character_id FROM activity
    WHERE play_minutes > 0
      AND activity_date >= (SELECT MIN(CAST(attempt_started_at AS DATE)) FROM attempts)
      AND activity_date <= (SELECT MAX(CAST(attempt_started_at AS DATE)) FROM attempts)"""


def _active_population() -> str:
    return _with("activity characters attempts", played=_PLAYED) + _POPULATION


def _analysis_period() -> str:
    return _with("attempts") + (
        f"SELECT {_day('MIN(attempt_started_at)')} AS start_date, {_day('MAX(attempt_started_at)')} AS end_date"
        " FROM attempts"
    )


_USED = f"""
    SELECT content_id, COUNT(*) AS attempt_count, {_PEOPLE}, COUNT(DISTINCT party_id) AS party_count,
           {", ".join(f"{_is(o)} AS {o}_count" for o in ('clear', 'fail', 'give_up', 'disconnect'))},
           COUNT(*) FILTER (WHERE result <> 'clear') AS non_clear_count, {_EFFORT},
           {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {_r('AVG(party_member_count)')} AS avg_party_member_count,
           MIN(attempt_started_at) AS first_at, MAX(attempt_started_at) AS last_at
    FROM attempts GROUP BY content_id"""


def _usage_facts() -> str:
    return _with("attempts", used=_USED) + f"""
        SELECT * EXCLUDE (first_at, last_at), {_day('first_at')} AS first_attempt_date,
               {_day('last_at')} AS last_attempt_date FROM used"""


def _usage_steps(targets: str) -> dict[str, str]:
    counts = (
        "attempt_count participant_account_count participant_character_count party_count clear_count fail_count"
        " give_up_count disconnect_count non_clear_count"
    ).split()
    filled = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in counts)
    base = f"""
        SELECT m.*, target_participation_rate, target_clear_rate, target_avg_clear_time_sec,
               u.* EXCLUDE (content_id, {", ".join(counts)}), {filled},
               (SELECT active_account_count FROM population) AS active_account_count,
               (SELECT active_character_count FROM population) AS active_character_count
        FROM content_master m LEFT JOIN aim a ON a.content_id = m.content_id
        LEFT JOIN used u ON u.content_id = m.content_id WHERE m.is_active = 1"""
    d2 = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 2) AS DECIMAL(20,2))".format
    outcome_rates = ", ".join(
        f"CASE attempt_count WHEN 0 THEN 0 ELSE {d2(_pct(f'{o}_count', 'attempt_count'))} END AS {o}_rate_pct"
        for o in ("clear", "fail", "give_up", "disconnect", "non_clear")
    )
    rated = f"""
        SELECT *, {d2(_pct('participant_account_count', 'active_account_count'))} AS account_participation_rate_pct,
               {d2(_pct('participant_character_count', 'active_character_count'))} AS character_participation_rate_pct,
               {d2(_pct('attempt_count', '(SELECT SUM(attempt_count) FROM base)'))} AS attempt_share_pct,
               {d2(_pct('participant_account_count', '(SELECT SUM(participant_account_count) FROM base)'))}
                   AS participant_account_share_pct,
               {outcome_rates},
               CASE participant_account_count WHEN 0 THEN 0
                    ELSE {d2('attempt_count * 1.0 / NULLIF(participant_account_count, 0)')} END
                   AS avg_attempts_per_participant_account
        FROM base"""
    peers = "PARTITION BY content_type, difficulty"
    rate = "account_participation_rate_pct"
    compared = f"""
        SELECT *, {rate} - target_participation_rate AS participation_rate_gap_pp,
               clear_rate_pct - target_clear_rate AS clear_rate_gap_pp,
               {d2(f"{rate} - CAST(AVG({rate}) OVER ({peers}) AS DECIMAL(28,8))")} AS peer_participation_gap_pp,
               {d2(f"attempt_count - CAST(AVG(attempt_count) OVER ({peers}) AS DECIMAL(28,8))")} AS peer_attempt_gap,
               rank() OVER (ORDER BY attempt_count DESC) AS total_attempt_rank,
               rank() OVER ({peers} ORDER BY attempt_count DESC) AS peer_attempt_rank,
               rank() OVER (ORDER BY {rate} DESC NULLS LAST) AS total_participation_rank,
               rank() OVER ({peers} ORDER BY {rate} DESC NULLS LAST) AS peer_participation_rank,
               {rate} >= CAST(AVG({rate}) OVER () AS DECIMAL(28,8)) AS much_used,
               non_clear_rate_pct >= CAST(AVG(non_clear_rate_pct) OVER () AS DECIMAL(28,8)) AS burdened
        FROM rated"""
    return {
        "played": _PLAYED,
        "population": _POPULATION,
        "aim": targets,
        "used": _USED,
        "base": base,
        "rated": rated,
        "compared": compared,
    }


def _content_usage_overview(targets: str) -> str:
    whole = (
        "content_id difficulty_order required_level recommended_combat_power min_party_size max_party_size"
        " entry_limit_count expected_clear_time_sec active_account_count active_character_count attempt_count"
        " participant_account_count participant_character_count party_count clear_count fail_count give_up_count"
        " disconnect_count non_clear_count target_avg_clear_time_sec total_attempt_rank peer_attempt_rank"
        " total_participation_rank peer_participation_rank"
    ).split()
    order = "array_position(['easy', 'normal', 'hard', 'mythic'], difficulty)"
    ints = ", ".join(f"{_n(order if c == 'difficulty_order' else c)} AS {c}" for c in whole)
    decimals = (
        "account_participation_rate_pct character_participation_rate_pct attempt_share_pct"
        " participant_account_share_pct avg_attempts_per_participant_account target_participation_rate"
        " participation_rate_gap_pp clear_rate_pct fail_rate_pct give_up_rate_pct disconnect_rate_pct"
        " non_clear_rate_pct target_clear_rate clear_rate_gap_pp avg_death_count avg_revive_count"
        " avg_potion_used_count avg_clear_time_sec avg_party_member_count peer_participation_gap_pp"
        " peer_attempt_gap"
    ).split()
    return _with("activity characters attempts content_master goals", **_usage_steps(targets)) + f"""
        SELECT {ints}, {", ".join(f"{_f(c)} AS {c}" for c in decimals)},
               {_r('avg_clear_time_sec - target_avg_clear_time_sec')} AS clear_time_gap_sec,
               regexp_replace(content_name, ' (Easy|Normal|Hard|Mythic)$', '') AS content_line_name,
               content_name, content_type, difficulty, entry_limit_type,
               {_day('first_at')} AS first_attempt_date, {_day('last_at')} AS last_attempt_date,
               CASE WHEN attempt_count = 0 THEN 'UNUSED' WHEN peer_participation_gap_pp <= -5 THEN 'BELOW_PEERS'
                    WHEN peer_participation_gap_pp >= 5 THEN 'ABOVE_PEERS' ELSE 'NEAR_PEERS'
               END AS participation_status,
               CASE WHEN participation_rate_gap_pp <= -5 THEN 'BELOW_TARGET'
                    WHEN participation_rate_gap_pp >= 5 THEN 'ABOVE_TARGET' ELSE 'NEAR_TARGET'
               END AS target_participation_status,
               CASE WHEN much_used IS NULL OR burdened IS NULL THEN 'OTHER'
                    ELSE (CASE WHEN much_used THEN 'HIGH' ELSE 'LOW' END) || '_USE_'
                         || (CASE WHEN burdened THEN 'HIGH' ELSE 'LOW' END) || '_FAILURE'
               END AS usage_failure_segment
        FROM compared"""


def _below_target_contents() -> str:
    return _with("activity characters attempts content_master goals", **_usage_steps(_NEWEST)) + (
        f"SELECT {_n('content_id')} AS content_id FROM compared WHERE clear_rate_pct < target_clear_rate"
    )


# ---------------------------------------------------------------- difficulty, participation, segments


def _difficulty_factors() -> str:
    actual = f"""
        SELECT content_id, content_name, m.difficulty, content_type, recommended_combat_power, n, clears, fails,
               give_ups, disconnects, deaths, clear_time, target_clear_rate, target_death_count_avg,
               target_avg_clear_time_sec,
               {_pct('clears', 'n')} AS clear_rate, {_pct('fails', 'n')} AS fail_rate,
               AVG({_pct('fails', 'n')}) OVER (PARTITION BY m.difficulty) AS peer_fail
        FROM (SELECT content_id, COUNT(*) AS n, {_is('clear')} AS clears, {_is('fail')} AS fails,
                     {_is('give_up')} AS give_ups, {_is('disconnect')} AS disconnects,
                     AVG(death_count) AS deaths, {_CLEAR_TIME} AS clear_time
              FROM attempts GROUP BY content_id)
        JOIN content_master m USING (content_id) JOIN aim USING (content_id)"""
    d8 = "CAST({} AS DECIMAL(28,8))".format
    gaps = f"""
        SELECT *, {d8('fail_rate - peer_fail')} AS fail_gap,
               {d8('(deaths - target_death_count_avg) * 100.0 / NULLIF(target_death_count_avg, 0)')} AS death_gap,
               {d8('(clear_time - target_avg_clear_time_sec) * 100.0 / NULLIF(target_avg_clear_time_sec, 0)')} AS time_gap
        FROM actual"""
    flags = """
        SELECT *, CASE WHEN fail_gap >= 5 THEN 1 ELSE 0 END AS f1, CASE WHEN death_gap >= 20 THEN 1 ELSE 0 END AS f2,
               CASE WHEN time_gap >= 20 THEN 1 ELSE 0 END AS f3 FROM gaps"""
    return _with(
        "attempts content_master goals", aim=_NEWEST, actual=actual, gaps=gaps, flags=flags
    ) + f"""
        SELECT {_n('content_id')} AS content_id, content_name, difficulty, content_type,
               {_n('recommended_combat_power')} AS recommended_combat_power, n AS total_attempt_count,
               clears AS clear_count, fails AS fail_count, give_ups AS give_up_count, disconnects AS disconnect_count,
               {_f('target_clear_rate')} AS target_clear_rate, {_r('clear_rate')} AS clear_rate_pct,
               {_r('clear_rate - target_clear_rate')} AS clear_rate_gap_pp, {_r('fail_rate')} AS fail_rate_pct,
               {_r('peer_fail')} AS difficulty_avg_fail_rate_pct, {_r('fail_gap')} AS fail_rate_gap_pp,
               {_f('target_death_count_avg')} AS target_death_count_avg, {_r('deaths')} AS avg_death_count,
               {_r('death_gap')} AS death_count_gap_pct,
               {_n('target_avg_clear_time_sec')} AS target_avg_clear_time_sec,
               {_r('clear_time')} AS avg_clear_time_sec, {_r('time_gap')} AS clear_time_gap_pct,
               {_n('f1')} AS fail_rate_flag, {_n('f2')} AS death_count_flag, {_n('f3')} AS clear_time_flag,
               {_n('f1 + f2 + f3')} AS difficulty_flag_sum,
               CASE f1 + f2 + f3 WHEN 0 THEN 'DIFFICULTY_UNLIKELY' WHEN 1 THEN 'DIFFICULTY_POSSIBLE'
                    ELSE 'DIFFICULTY_LIKELY' END AS difficulty_verdict
        FROM flags"""


_ELIGIBLE_ALL = """
    SELECT m.content_id,
           COUNT(*) FILTER (WHERE level >= required_level AND combat_power >= recommended_combat_power)
               AS eligible_character_count_100,
           COUNT(*) FILTER (WHERE level >= required_level AND combat_power >= 0.8 * recommended_combat_power)
               AS eligible_character_count_80
    FROM content_master m CROSS JOIN (SELECT * FROM characters WHERE is_deleted = 0)
    WHERE m.is_active = 1 GROUP BY m.content_id"""


def _eligible_characters() -> str:
    return _with("characters content_master", eligible=_ELIGIBLE_ALL) + (
        f"SELECT * REPLACE ({_n('content_id')} AS content_id) FROM eligible"
    )


def _people(condition: str) -> str:
    return f"COUNT(DISTINCT character_id) FILTER (WHERE {condition})"


_TRIED = f"""
    SELECT content_id, COUNT(*) AS n, COUNT(DISTINCT character_id) AS c_all,
           {_people('level >= required_level AND combat_power >= recommended_combat_power')} AS c_100,
           {_people('level >= required_level AND combat_power >= 0.8 * recommended_combat_power')} AS c_80,
           {_people('level < required_level OR combat_power < 0.8 * recommended_combat_power')} AS c_under,
           {_is('clear')} AS clears, {_is('fail')} AS fails, {_is('give_up')} AS give_ups,
           {_is('disconnect')} AS disconnects
    FROM attempts JOIN content_master USING (content_id) JOIN characters USING (character_id)
    WHERE is_deleted = 0 GROUP BY content_id"""


def _challengers() -> str:
    return _with("attempts characters content_master", tried=_TRIED) + """
        SELECT content_id, n AS total_attempt_count, c_all AS actual_attempt_character_count,
               c_100 AS actual_attempt_character_count_100, c_80 AS actual_attempt_character_count_80,
               c_under AS actual_attempt_character_count_under_80, clears AS clear_count, fails AS fail_count,
               give_ups AS give_up_count, disconnects AS disconnect_count
        FROM tried"""


def _eligible_participation() -> str:
    d8 = "CAST({} AS DECIMAL(28,8))".format
    rates = f"""
        SELECT m.*, e.* EXCLUDE (content_id), COALESCE(n, 0) AS n, COALESCE(c_all, 0) AS c_all,
               COALESCE(c_100, 0) AS c_100, COALESCE(c_80, 0) AS c_80, COALESCE(c_under, 0) AS c_under,
               {_pct('COALESCE(c_100, 0)', 'eligible_character_count_100')} AS rate_100,
               {_pct('COALESCE(c_80, 0)', 'eligible_character_count_80')} AS rate_80,
               {_pct('c_under', 'c_all')} AS under_80, n * 1.0 / NULLIF(c_all, 0) AS repeats,
               {_pct('clears', 'n')} AS clear_rate, {_pct('fails', 'n')} AS fail_rate,
               {_pct('give_ups', 'n')} AS give_up_rate, {_pct('disconnects', 'n')} AS disconnect_rate
        FROM content_master m JOIN eligible e USING (content_id) LEFT JOIN tried t ON t.content_id = m.content_id"""
    same = "OVER (PARTITION BY difficulty)"
    compared = f"""
        SELECT *, {d8(f'AVG(rate_100) {same}')} AS peer_100, {d8(f'AVG(rate_80) {same}')} AS peer_80,
               {d8(f'AVG(repeats) {same}')} AS peer_repeats, {d8(f'AVG(n) {same}')} AS peer_n FROM rates"""
    return _with(
        "attempts characters content_master", eligible=_ELIGIBLE_ALL, tried=_TRIED, rates=rates, compared=compared
    ) + f"""
        SELECT {_n('content_id')} AS content_id, content_name, content_type, difficulty,
               {_n('required_level')} AS required_level, {_n('recommended_combat_power')} AS recommended_combat_power,
               eligible_character_count_100, eligible_character_count_80,
               c_all AS actual_attempt_character_count, c_100 AS actual_attempt_character_count_100,
               c_80 AS actual_attempt_character_count_80, c_under AS actual_attempt_character_count_under_80,
               n AS total_attempt_count, {_r('rate_100')} AS participation_rate_100_pct,
               {_r('rate_80')} AS participation_rate_80_pct, {_r('under_80')} AS under_80_character_share_pct,
               {_r('peer_100')} AS difficulty_avg_participation_rate_100_pct,
               {_r(f"{d8('rate_100')} - peer_100")} AS participation_rate_100_gap_pp,
               {_r('peer_80')} AS difficulty_avg_participation_rate_80_pct,
               {_r(f"{d8('rate_80')} - peer_80")} AS participation_rate_80_gap_pp,
               {_r('repeats')} AS avg_attempts_per_character,
               {_r('peer_repeats')} AS difficulty_avg_attempts_per_character,
               {_r(f"{d8('repeats')} - peer_repeats")} AS attempts_per_character_gap,
               {_r('peer_n', 0)} AS difficulty_avg_attempt_count, {_r('n - peer_n', 0)} AS attempt_count_gap,
               {_r('clear_rate')} AS clear_rate_pct, {_r('fail_rate')} AS fail_rate_pct,
               {_r('give_up_rate')} AS give_up_rate_pct, {_r('disconnect_rate')} AS disconnect_rate_pct,
               CASE WHEN {d8('rate_80')} < peer_80 AND {d8('repeats')} < peer_repeats THEN 'LOW_ENTRY_LOW_REPEAT'
                    WHEN {d8('rate_80')} < peer_80 AND {d8('repeats')} >= peer_repeats THEN 'LOW_ENTRY_BUT_REPEATING'
                    WHEN {d8('rate_80')} >= peer_80 AND {d8('fail_rate')} >= 50 THEN 'ENTERED_BUT_FAILING'
                    WHEN {d8('under_80')} >= 30 THEN 'MANY_UNDER_POWERED'
                    WHEN {d8('rate_80')} >= peer_80 THEN 'HEALTHY'
                    ELSE 'CHECK_FURTHER' END AS participation_verdict
        FROM compared"""


def _power_segments(targets: str) -> str:
    rows = f"""
        SELECT content_id, content_name, m.difficulty, party_member_count, character_id, result,
               recommended_combat_power,
               CASE WHEN COALESCE(recommended_combat_power, 0) = 0 THEN '05_120_and_over' ELSE {_BAND} END AS power_band
        FROM attempts JOIN characters USING (character_id) JOIN content_master m USING (content_id)"""
    grouped = f"""
        SELECT content_id, content_name, difficulty, party_member_count, power_band, recommended_combat_power,
               target_clear_rate, COUNT(*) AS n, COUNT(DISTINCT character_id) AS people, {_is('clear')} AS clears,
               {_is('fail')} AS fails,
               CAST(ROUND(CAST({_pct(_is('clear'), 'COUNT(*)')} AS DECIMAL(28,8)), 2) AS DECIMAL(20,2)) AS clear_rate
        FROM rows JOIN (SELECT content_id, difficulty, target_clear_rate FROM aim) USING (content_id, difficulty)
        GROUP BY ALL"""
    return _with("attempts characters content_master goals", aim=targets, rows=rows, grouped=grouped) + f"""
        SELECT content_id, content_name, difficulty, CAST(party_member_count AS VARCHAR) || '인' AS party_size,
               power_band, {_n('recommended_combat_power')} AS recommended_combat_power, n AS attempt_count,
               people AS character_count, clears AS clear_count, {_f('clear_rate')} AS clear_rate_pct,
               {_f('target_clear_rate')} AS target_clear_rate,
               {_r('clear_rate - target_clear_rate')} AS clear_rate_gap_pp, fails AS fail_count,
               {_r(_pct('fails', 'n'))} AS fail_rate_pct, 'BELOW_TARGET' AS target_status
        FROM grouped WHERE clear_rate < target_clear_rate"""


def _of_below_target(report: str) -> str:
    return f"SELECT * FROM ({report}) WHERE content_id IN (SELECT content_id FROM ({_below_target_contents()}))"


# ---------------------------------------------------------------- rewards


def _reward_by_result() -> str:
    paid = f"""
        SELECT attempt_id, SUM(quantity) AS quantity, SUM(estimated_gold_value) AS worth
        FROM reward_logs WHERE content_id = {FOCUS_CONTENT} GROUP BY attempt_id"""
    rows = f"""
        SELECT a.*, {_DURATION} AS seconds, COALESCE(quantity, 0) AS quantity, worth
        FROM attempts a JOIN characters USING (character_id) LEFT JOIN paid p ON p.attempt_id = a.attempt_id
        WHERE a.content_id = {FOCUS_CONTENT}"""
    return _with("attempts characters reward_logs", paid=paid, rows=rows) + f"""
        SELECT result, COUNT(*) AS attempt_count, COUNT(DISTINCT character_id) AS character_count,
               {_r(_pct('COUNT(*)', '(SELECT COUNT(*) FROM rows)'))} AS attempt_share_pct,
               {_r('AVG(death_count)')} AS avg_death_count, {_r('AVG(seconds)')} AS avg_duration_sec,
               COUNT(*) FILTER (WHERE reward_claimed = 1) AS reward_claimed_count,
               {_r('AVG(quantity)')} AS avg_reward_quantity, {_r('AVG(COALESCE(worth, 0))')} AS avg_reward_value,
               {_r('AVG(worth)')} AS avg_reward_value_when_paid,
               {_r('AVG(COALESCE(worth, 0) * 60.0 / NULLIF(seconds, 0))')} AS avg_reward_value_per_minute
        FROM rows GROUP BY result"""


_WORTH = "SELECT attempt_id, SUM(estimated_gold_value) AS worth FROM reward_logs GROUP BY attempt_id"
_PAID_ROWS = f"""
    SELECT a.*, {_DURATION} AS seconds, COALESCE(worth, 0) AS reward
    FROM attempts a LEFT JOIN worth w ON w.attempt_id = a.attempt_id"""
_PER_CLEAR_MINUTE = "AVG(reward * 60.0 / NULLIF(clear_time_sec, 0)) FILTER (WHERE result = 'clear')"
_PER_CLEAR = "AVG(reward) FILTER (WHERE result = 'clear')"


def _reward_by_tier() -> str:
    rates = ", ".join(
        f"{_r(_pct(_is(o), 'COUNT(*)'))} AS {o}_rate_pct" for o in ("clear", "fail", "give_up", "disconnect")
    )
    return _with("attempts content_master reward_logs", worth=_WORTH, rows=_PAID_ROWS) + f"""
        SELECT {_n('content_id')} AS content_id, content_name, content_type, m.difficulty, COUNT(*) AS attempt_count,
               COUNT(DISTINCT character_id) AS character_count, {rates},
               {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {_r('AVG(seconds)')} AS avg_duration_sec,
               {_r(_PER_CLEAR)} AS avg_reward_value_per_clear, {_r('AVG(reward)')} AS avg_reward_value,
               {_r(_PER_CLEAR_MINUTE)} AS clear_reward_value_per_minute,
               {_r('AVG(reward * 60.0 / NULLIF(seconds, 0))')} AS reward_value_per_minute
        FROM rows JOIN content_master m USING (content_id) WHERE m.difficulty = '{FOCUS_TIER}' GROUP BY ALL"""


def _reward_by_line() -> str:
    rates = ", ".join(f"{_r(_pct(_is(o), 'COUNT(*)'))} AS {o}_rate_pct" for o in ("clear", "fail", "give_up"))
    return _with("attempts content_master reward_logs", worth=_WORTH, rows=_PAID_ROWS) + f"""
        SELECT {_n('content_id')} AS content_id, content_name, m.difficulty,
               {_n('recommended_combat_power')} AS recommended_combat_power,
               {_n('expected_clear_time_sec')} AS expected_clear_time_sec, COUNT(*) AS attempt_count,
               COUNT(DISTINCT character_id) AS character_count, {rates},
               {_r(_CLEAR_TIME)} AS avg_clear_time_sec, {_r(_PER_CLEAR)} AS avg_reward_value_per_clear,
               {_r(_PER_CLEAR_MINUTE)} AS clear_reward_value_per_minute, {_r('AVG(reward)')} AS avg_reward_value
        FROM rows JOIN content_master m USING (content_id)
        WHERE regexp_replace(content_name, ' (Easy|Normal|Hard|Mythic)$', '') = '{FOCUS_LINE}' GROUP BY ALL"""


# ---------------------------------------------------------------- one content


def _release_maturity() -> str:
    facts = f"""
        SELECT content_id, CAST(MIN(attempt_started_at) AS DATE) AS first_day,
               CAST(MAX(attempt_started_at) AS DATE) AS last_day, COUNT(*) AS n,
               COUNT(DISTINCT character_id) AS people, {_is('clear')} AS clears
        FROM attempts WHERE content_id = {FOCUS_CONTENT} GROUP BY content_id"""
    age = "date_diff('day', release_date, last_day)"
    return _with("attempts content_master goals", aim=_NEWEST_TIES, facts=facts) + f"""
        SELECT f.content_id, content_name, content_type, m.difficulty, {_day('release_date')} AS release_date,
               {_day('first_day')} AS first_attempt_date, {_day('last_day')} AS reference_date,
               {age} AS days_since_release, n AS attempt_count, people AS character_count,
               {_f('target_clear_rate')} AS target_clear_rate, {_r(_pct('clears', 'n'))} AS clear_rate_pct,
               {_r(f"{_pct('clears', 'n')} - target_clear_rate")} AS clear_rate_gap_pp,
               CASE WHEN {age} >= 90 THEN 'SETTLED' WHEN {age} >= 30 THEN 'SETTLING' ELSE 'OBSERVE' END AS release_stage
        FROM facts f JOIN content_master m ON m.content_id = f.content_id
        LEFT JOIN aim a ON a.content_id = m.content_id AND a.difficulty = m.difficulty"""


def _band_rows() -> str:
    return f"""
        SELECT a.*, m.difficulty, combat_power, recommended_combat_power, {_BAND} AS power_band
        FROM attempts a JOIN characters USING (character_id) JOIN content_master m ON m.content_id = a.content_id
        WHERE a.content_id = {FOCUS_CONTENT}"""


def _band_performance() -> str:
    grouped = f"""
        SELECT power_band, content_id, difficulty, COUNT(*) AS n, COUNT(DISTINCT character_id) AS people,
               AVG(combat_power) AS power, AVG(combat_power * 100.0 / recommended_combat_power) AS ratio,
               {", ".join(f"{_pct(_is(o), 'COUNT(*)')} AS {o}_rate" for o in ('clear', 'fail', 'give_up', 'disconnect'))},
               AVG(death_count) AS deaths, {_CLEAR_TIME} AS clear_time
        FROM rows GROUP BY ALL"""
    rates = ", ".join(f"{_r(f'{o}_rate')} AS {o}_rate_pct" for o in ("clear", "fail", "give_up", "disconnect"))
    return _with(
        "attempts characters content_master goals", aim=_NEWEST_TIES, rows=_band_rows(), grouped=grouped
    ) + f"""
        SELECT power_band, n AS attempt_count, people AS character_count, {_r('power', 0)} AS avg_combat_power,
               {_r('ratio')} AS avg_power_ratio_pct, {_f('target_clear_rate')} AS target_clear_rate, {rates},
               {_r('clear_rate - target_clear_rate')} AS clear_rate_gap_pp, {_r('deaths')} AS avg_death_count,
               {_f('target_death_count_avg')} AS target_death_count_avg,
               {_r('deaths - target_death_count_avg')} AS death_count_gap, {_r('clear_time')} AS avg_clear_time_sec,
               {_n('target_avg_clear_time_sec')} AS target_avg_clear_time_sec,
               {_r('clear_time - target_avg_clear_time_sec')} AS clear_time_gap_sec
        FROM grouped LEFT JOIN aim USING (content_id, difficulty)"""


def _rewards_per_attempt() -> str:
    return _with("reward_logs") + f"""
        SELECT attempt_id, COUNT(*) AS reward_row_count, {_n('SUM(quantity)')} AS reward_quantity,
               {_f('SUM(estimated_gold_value)')} AS reward_value
        FROM reward_logs WHERE attempt_id IS NOT NULL GROUP BY attempt_id"""


def _pattern_attempts() -> str:
    return _with("pattern_logs attempts") + f"""
        SELECT l.attempt_id, pattern_code, pattern_name, {_n('phase_no')} AS phase_no,
               {_n('MAX(was_hit)')} AS was_hit, {_n('MAX(is_fatal)')} AS is_fatal,
               {_f('SUM(damage_taken)')} AS total_damage_taken,
               {_r('AVG(damage_taken) FILTER (WHERE was_hit = 1)')} AS avg_damage_when_hit, a.result
        FROM pattern_logs l JOIN attempts a ON a.attempt_id = l.attempt_id
        WHERE l.content_id = {FOCUS_CONTENT} AND a.content_id = {FOCUS_CONTENT} GROUP BY ALL"""


def _pattern_impact() -> str:
    seen = f"""
        SELECT l.attempt_id, phase_no, pattern_code, pattern_name, MAX(was_hit) = 1 AS hit, MAX(is_fatal) = 1 AS fatal,
               AVG(damage_taken) FILTER (WHERE was_hit = 1) AS damage, ANY_VALUE(result) = 'fail' AS failed
        FROM pattern_logs l JOIN attempts a ON a.attempt_id = l.attempt_id AND a.content_id = {FOCUS_CONTENT}
        WHERE l.content_id = {FOCUS_CONTENT} GROUP BY ALL"""

    def n(condition: str) -> str:
        return f"COUNT(*) FILTER (WHERE {condition})"

    hit, missed = _pct(n("hit AND failed"), n("hit")), _pct(n("NOT hit AND failed"), n("NOT hit"))
    return _with("pattern_logs attempts", seen=seen) + f"""
        SELECT {_n('phase_no')} AS phase_no, pattern_code, pattern_name, COUNT(*) AS exposed_attempt_count,
               {n('hit')} AS hit_attempt_count, {_r(_pct(n('hit'), 'COUNT(*)'))} AS hit_rate_pct,
               {n('fatal')} AS fatal_attempt_count, {_r(_pct(n('fatal'), 'COUNT(*)'))} AS fatal_share_pct,
               {_r('AVG(damage)')} AS avg_damage_when_hit, {_r(_pct(n('failed'), 'COUNT(*)'))} AS fail_rate_pct,
               {_r(hit)} AS fail_rate_hit_pct, {_r(missed)} AS fail_rate_avoided_pct,
               {_r(f"{hit} - {missed}")} AS fail_rate_difference_pp
        FROM seen GROUP BY phase_no, pattern_code, pattern_name"""


def _pattern_by_result() -> str:
    return _with("pattern_logs attempts") + f"""
        SELECT result, COUNT(DISTINCT attempt_id) AS pattern_attempt_count, COUNT(*) AS pattern_log_count,
               {_n('SUM(was_hit)')} AS hit_log_count, {_r(_pct('SUM(was_hit)', 'COUNT(*)'))} AS hit_rate_pct,
               {_n('SUM(is_fatal)')} AS fatal_log_count, {_r(_pct('SUM(is_fatal)', 'COUNT(*)'))} AS fatal_share_pct,
               {_r('AVG(damage_taken)')} AS avg_damage
        FROM pattern_logs l JOIN attempts USING (attempt_id)
        WHERE l.content_id = {FOCUS_CONTENT} AND pattern_code = '{FOCUS_PATTERN}' GROUP BY result"""


def _pattern_incidence_by_band() -> str:
    marked = f"""
        SELECT *, attempt_id IN (SELECT attempt_id FROM pattern_logs WHERE content_id = {FOCUS_CONTENT}
               AND pattern_code = '{FOCUS_PATTERN}') AS incident FROM rows"""
    incidents = "COUNT(*) FILTER (WHERE incident)"
    return _with(
        "attempts characters content_master pattern_logs", rows=_band_rows(), marked=marked
    ) + f"""
        SELECT power_band, COUNT(*) AS attempt_count, {_is('fail')} AS fail_count,
               {incidents} AS pattern_attempt_count, {_r(_pct(incidents, 'COUNT(*)'))} AS pattern_rate_pct,
               {_r(_pct(incidents, _is('fail')))} AS pattern_per_fail_pct,
               {_r(_pct(_is('clear'), 'COUNT(*)'))} AS clear_rate_pct,
               {_r(_pct(_is('fail'), 'COUNT(*)'))} AS fail_rate_pct
        FROM marked GROUP BY power_band"""


def statements() -> dict[str, str]:
    return {
        "load_quarantine": _load_quarantine(),
        "dq_rules": _dq_rules(),
        "dq_reward_on_failed": _dq_reward_on_failed(),
        "dq_orphan_multi_parent": _dq_orphan_multi_parent(),
        "dq_fk_orphans": "SELECT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)",
        "dq_fk_summary": _dq_fk_summary(),
        "dq_pk_duplicates": (
            "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS n FROM lineitem"
            " GROUP BY ALL HAVING COUNT(*) > 1"
        ),
        "dq_null_profile": _dq_null_profile(),
        "dq_null_profile_all": _dq_null_profile_all(),
        "dq_pk_duplicates_all": _dq_pk_duplicates_all(),
        "dq_fk_orphans_all": _dq_fk_orphans_all(),
        "dq_orphan_attempts": _dq_orphan_attempts(),
        "table_row_counts": _table_row_counts(),
        "date_spans": _date_spans(),
        "population_summary": _population_summary(),
        "daily_kpis": _daily_kpis(),
        "daily_result_distribution": _daily_result_distribution(),
        "overall_attempt_summary": _overall_attempt_summary(),
        "result_share": _result_share(),
        "content_health": _content_health(),
        "content_health_rollup": _content_health_rollup(),
        "worst_contents": _worst_contents(),
        "eligible_by_content": _eligible_by_content(),
        "retry_summary": _retry_summary(),
        "content_health_gap": _content_health_gap(_NEWEST_BY_END),
        "content_health_gap_all_targets": _content_health_gap(
            f"SELECT * FROM goals WHERE valid_from <= DATE '{WINDOW_END}'"
        ),
        "target_lookup": _target_lookup(),
        "targets_asof": _targets_asof(),
        "active_population": _active_population(),
        "content_usage_overview": _content_usage_overview(_NEWEST),
        "content_usage_overview_all_targets": _content_usage_overview("SELECT * FROM goals"),
        "below_target_contents": _below_target_contents(),
        "difficulty_factors": _difficulty_factors(),
        "eligible_characters": _eligible_characters(),
        "eligible_participation": _eligible_participation(),
        "difficulty_factors_below_target": _of_below_target(_difficulty_factors()),
        "eligible_participation_below_target": _of_below_target(_eligible_participation()),
        "power_segments_below_target": _of_below_target(_power_segments(_NEWEST)),
        "power_segments": _power_segments(_NEWEST),
        "power_segments_all_targets": _power_segments("SELECT * FROM goals"),
        "reward_by_result": _reward_by_result(),
        "reward_by_tier": _reward_by_tier(),
        "reward_by_line": _reward_by_line(),
        "release_maturity": _release_maturity(),
        "band_performance": _band_performance(),
        "pattern_impact": _pattern_impact(),
        "pattern_by_result": _pattern_by_result(),
        "pattern_incidence_by_band": _pattern_incidence_by_band(),
        "active_characters": _active_characters(),
        "attempt_summary": _attempt_summary(),
        "reward_summary": _reward_summary(),
        "analysis_period": _analysis_period(),
        "usage_facts": _usage_facts(),
        "challengers": _challengers(),
        "rewards_per_attempt": _rewards_per_attempt(),
        "pattern_attempts": _pattern_attempts(),
    }
