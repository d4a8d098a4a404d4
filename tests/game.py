"""Small hand-made tables in the declared layout; unnamed columns get plain defaults."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import types as T

from playgauge.sources.schemas import TABLES

DEFAULTS = {
    T.LongType: 0,
    T.IntegerType: 0,
    T.ByteType: 0,
    T.DecimalType: Decimal("0.00"),
    T.StringType: "x",
    T.TimestampNTZType: datetime(2026, 5, 10, 12),
    T.DateType: date(2026, 5, 10),
}


def make(spark, name, rows):
    table = TABLES[name]
    lines = []
    for i, row in enumerate(rows):
        unknown = set(row) - set(table.names)
        assert not unknown, unknown
        line = []
        for column in table.columns:
            if column.name in row:
                line.append(row[column.name])
            elif (column.name,) == table.key:
                line.append(i + 1)
            elif column.required:
                line.append(DEFAULTS[type(column.data_type)])
            else:
                line.append(None)
        lines.append(tuple(line))
    return spark.createDataFrame(lines, table.schema)


def day(text):
    return datetime.fromisoformat(text)


def contents(spark):
    """1 regular, 2 without attempts, 3 inactive, 4 without a usable recommended power, 5 peer of 1."""
    base = {"content_type": "raid", "release_date": date(2026, 4, 1), "is_active": 1, "required_level": 10}
    return make(
        spark,
        "content_master",
        [
            {**base, "content_id": 1, "content_name": "Cave Hard", "difficulty": "hard", "recommended_combat_power": 1000},
            {**base, "content_id": 2, "content_name": "Cave Easy", "difficulty": "easy", "recommended_combat_power": 500},
            {**base, "content_id": 3, "content_name": "Old Hard", "difficulty": "hard", "recommended_combat_power": 900, "is_active": 0},
            {**base, "content_id": 4, "content_name": "Field", "difficulty": "normal", "recommended_combat_power": 0},
            {**base, "content_id": 5, "content_name": "Tower Hard", "difficulty": "hard", "recommended_combat_power": 2000},
        ],
    )


def characters(spark):
    """1-8 on the band edges of content 1, 9 under level, 10 deleted."""
    powers = [799, 800, 999, 1000, 1099, 1100, 1199, 1200]
    rows = [{"character_id": i + 1, "account_id": (i + 2) // 2, "level": 10, "combat_power": p} for i, p in enumerate(powers)]
    rows.append({"character_id": 9, "account_id": 5, "level": 9, "combat_power": 5000})
    rows.append({"character_id": 10, "account_id": 5, "level": 50, "combat_power": 5000, "is_deleted": 1})
    return make(spark, "characters", rows)


def goals(spark):
    """Content 1: two versions and one future; content 4: a tie on the newest start."""
    base = {"target_death_count_avg": Decimal("2.00"), "target_avg_clear_time_sec": 100}
    return make(
        spark,
        "content_design_goals",
        [
            {**base, "goal_id": 1, "content_id": 1, "difficulty": "hard", "target_clear_rate": Decimal("52.00"),
             "target_participation_rate": Decimal("50.00"), "valid_from": date(2026, 1, 1)},
            {**base, "goal_id": 2, "content_id": 1, "difficulty": "hard", "target_clear_rate": Decimal("60.00"),
             "target_participation_rate": Decimal("50.00"), "valid_from": date(2026, 3, 1)},
            {**base, "goal_id": 3, "content_id": 1, "difficulty": "hard", "target_clear_rate": Decimal("70.00"),
             "target_participation_rate": Decimal("50.00"), "valid_from": date(2027, 1, 1)},
            {**base, "goal_id": 4, "content_id": 4, "difficulty": "normal", "target_clear_rate": Decimal("10.00"),
             "valid_from": date(2026, 1, 1)},
            {**base, "goal_id": 5, "content_id": 4, "difficulty": "normal", "target_clear_rate": Decimal("20.00"),
             "valid_from": date(2026, 1, 1)},
            {**base, "goal_id": 6, "content_id": 5, "difficulty": "hard", "target_clear_rate": Decimal("30.00"),
             "valid_from": date(2026, 1, 1)},
        ],
    )


def attempts(spark):
    """All results, a clear without time, an end before its start, an open end, a zero duration."""
    start = day("2026-05-10 12:00:00")
    rows = [
        {"content_id": 1, "character_id": 1, "account_id": 1, "result": "clear", "clear_time_sec": 90, "death_count": 1, "party_member_count": 4, "reward_claimed": 1, "party_id": 1},
        {"content_id": 1, "character_id": 1, "account_id": 1, "result": "fail", "death_count": 5, "party_member_count": 4, "party_id": 1,
         "attempt_ended_at": day("2026-05-10 12:05:00")},
        {"content_id": 1, "character_id": 2, "account_id": 1, "result": "clear", "death_count": 2, "party_member_count": 4, "reward_claimed": 1},
        {"content_id": 1, "character_id": 4, "account_id": 2, "result": "give_up", "death_count": 3, "party_member_count": 1,
         "attempt_ended_at": day("2026-05-10 11:59:00")},
        {"content_id": 1, "character_id": 8, "account_id": 4, "result": "disconnect", "death_count": 0, "party_member_count": 1,
         "attempt_ended_at": start},
        {"content_id": 1, "character_id": 10, "account_id": 5, "result": "fail", "death_count": 9, "party_member_count": 4,
         "attempt_ended_at": day("2026-05-10 12:01:00")},
        {"content_id": 4, "character_id": 3, "account_id": 2, "result": "clear", "clear_time_sec": 0, "death_count": 0, "party_member_count": 2, "reward_claimed": 0},
        {"content_id": 5, "character_id": 9, "account_id": 5, "result": "fail", "death_count": 4, "party_member_count": 2,
         "attempt_started_at": day("2026-06-20 00:00:00")},
        {"content_id": 3, "character_id": 5, "account_id": 3, "result": "clear", "clear_time_sec": 50, "party_member_count": 1},
    ]
    return make(spark, "content_attempts", [{"attempt_started_at": start, **r} for r in rows])


def activity(spark):
    """Two characters on one account, a day without play, an impossible day, days outside the window."""
    rows = [
        {"activity_date": date(2026, 5, 10), "account_id": 1, "character_id": 1, "play_minutes": 60, "login_count": 1},
        {"activity_date": date(2026, 5, 10), "account_id": 1, "character_id": 2, "play_minutes": 30, "login_count": 2},
        {"activity_date": date(2026, 5, 11), "account_id": 1, "character_id": 1, "play_minutes": 0},
        {"activity_date": date(2026, 5, 12), "account_id": 2, "character_id": 4, "play_minutes": 1441},
        {"activity_date": date(2026, 5, 13), "account_id": 4, "character_id": 8, "play_minutes": 1440},
        {"activity_date": date(2026, 5, 13), "account_id": 5, "character_id": 9, "play_minutes": 10},
        {"activity_date": date(2026, 5, 13), "account_id": 5, "character_id": 10, "play_minutes": 10},
        {"activity_date": date(2026, 5, 14), "account_id": 3, "character_id": 5, "play_minutes": 0},
        {"activity_date": date(2026, 4, 30), "account_id": 2, "character_id": 3, "play_minutes": 10},
    ]
    return make(spark, "daily_activity", rows)


def rewards(spark):
    """Two rows on one attempt, no value, no attempt, no content, rewards on failed attempts."""
    at = day("2026-05-10 13:00:00")
    rows = [
        {"attempt_id": 1, "content_id": 1, "quantity": 2, "estimated_gold_value": 300, "reward_source": "content_clear"},
        {"attempt_id": 1, "content_id": 1, "quantity": 1, "estimated_gold_value": None, "reward_source": "content_clear"},
        {"attempt_id": 1, "content_id": None, "quantity": 5, "estimated_gold_value": 1000, "reward_source": "drop"},
        {"attempt_id": 2, "content_id": 1, "quantity": 1, "estimated_gold_value": 60, "reward_source": "content_clear"},
        {"attempt_id": 4, "content_id": 1, "quantity": 1, "estimated_gold_value": 10, "reward_source": "content_clear"},
        {"attempt_id": 6, "content_id": 1, "quantity": 1, "estimated_gold_value": 10, "reward_source": "drop"},
        {"attempt_id": None, "content_id": 1, "quantity": 7, "estimated_gold_value": 7000, "reward_source": "content_clear"},
        {"attempt_id": 999, "content_id": 1, "quantity": 7, "estimated_gold_value": 7000, "reward_source": "content_clear"},
    ]
    return make(spark, "reward_logs", [{"rewarded_at": at, **r} for r in rows])


def patterns(spark):
    """P1 hits sometimes, P2 always, P3 never; several logs per attempt; P1 in two phases."""
    rows = [
        {"attempt_id": 1, "phase_no": 1, "pattern_code": "P1", "was_hit": 1, "damage_taken": 10},
        {"attempt_id": 1, "phase_no": 1, "pattern_code": "P1", "was_hit": 1, "damage_taken": 20},
        {"attempt_id": 1, "phase_no": 1, "pattern_code": "P1", "was_hit": 0, "damage_taken": 0},
        {"attempt_id": 2, "phase_no": 1, "pattern_code": "P1", "was_hit": 1, "damage_taken": 40, "is_fatal": 1},
        {"attempt_id": 3, "phase_no": 1, "pattern_code": "P1", "was_hit": 0, "damage_taken": 0},
        {"attempt_id": 2, "phase_no": 2, "pattern_code": "P1", "was_hit": 0, "damage_taken": 0},
        {"attempt_id": 2, "phase_no": 2, "pattern_code": "P2", "was_hit": 1, "damage_taken": 100, "is_fatal": 1},
        {"attempt_id": 6, "phase_no": 2, "pattern_code": "P2", "was_hit": 1, "damage_taken": 101},
        {"attempt_id": 4, "phase_no": 1, "pattern_code": "P3", "was_hit": 0, "damage_taken": 0},
        {"attempt_id": 999, "phase_no": 1, "pattern_code": "P1", "was_hit": 1, "damage_taken": 77},
        {"attempt_id": 7, "phase_no": 1, "pattern_code": "P1", "was_hit": 1, "damage_taken": 77, "content_id": 4},
    ]
    return make(spark, "boss_pattern_logs", [{"content_id": 1, "pattern_name": r["pattern_code"], **r} for r in rows])
