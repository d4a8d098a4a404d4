"""Declared tables: column types, nullability, lengths, keys and parents.

Fixed values: names, order and types follow the published data layout, which
files are loaded by position against.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "flag": T.ByteType(),
    "rate": T.DecimalType(5, 2),
    "text": T.StringType(),
    "time": T.TimestampNTZType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class Col:
    name: str
    kind: str
    required: bool = True
    max_length: int | None = None

    @property
    def data_type(self) -> T.DataType:
        return _TYPES[self.kind]


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Col, ...]
    key: tuple[str, ...] = ()
    parents: tuple[ForeignKey, ...] = ()
    time_column: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.data_type, not c.required) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def _text(name: str, length: int, required: bool = True) -> Col:
    return Col(name, "text", required, length)


def _opt(name: str, kind: str) -> Col:
    return Col(name, kind, required=False)


def _all(kind: str, *names: str) -> tuple[Col, ...]:
    return tuple(Col(n, kind) for n in names)


_ACCOUNT = ForeignKey("account_id", "accounts", "account_id")
_CHARACTER = ForeignKey("character_id", "characters", "character_id")
_CONTENT = ForeignKey("content_id", "content_master", "content_id")
_ATTEMPT = ForeignKey("attempt_id", "content_attempts", "attempt_id")

_DECLARED = (
    Table(
        "accounts",
        (
            Col("account_id", "long"),
            Col("created_at", "time"),
            _opt("last_login_at", "time"),
            _text("signup_channel", 30),
            _text("platform", 20),
            _text("country_code", 2),
            _text("account_status", 20),
            Col("is_tester", "flag"),
            _opt("marketing_opt_in", "flag"),
        ),
        key=("account_id",),
        time_column="created_at",
    ),
    Table(
        "characters",
        (
            *_all("long", "character_id", "account_id"),
            Col("server_id", "int"),
            _text("character_name", 50),
            _text("class_name", 30),
            Col("created_at", "time"),
            Col("level", "int"),
            Col("combat_power", "long"),
            *_all("int", "gear_score", "main_story_chapter"),
            _opt("guild_id", "long"),
            Col("is_deleted", "flag"),
        ),
        key=("character_id",),
        parents=(_ACCOUNT,),
        time_column="created_at",
    ),
    Table(
        "content_master",
        (
            Col("content_id", "long"),
            _text("content_name", 100),
            _text("content_type", 30),
            _text("difficulty", 20),
            Col("required_level", "int"),
            Col("recommended_combat_power", "long"),
            *_all("int", "min_party_size", "max_party_size"),
            _text("entry_limit_type", 20),
            _opt("entry_limit_count", "int"),
            Col("expected_clear_time_sec", "int"),
            Col("release_date", "date"),
            Col("is_active", "flag"),
        ),
        key=("content_id",),
    ),
    Table(
        "content_design_goals",
        (
            *_all("long", "goal_id", "content_id"),
            _text("difficulty", 20),
            _text("season_id", 20),
            *_all("rate", "target_participation_rate", "target_clear_rate"),
            Col("target_avg_clear_time_sec", "int"),
            *_all("rate", "target_retry_rate", "target_death_count_avg"),
            Col("target_reward_value", "long"),
            Col("valid_from", "date"),
            _opt("valid_to", "date"),
        ),
        key=("goal_id",),
        parents=(_CONTENT,),
    ),
    Table(
        "daily_activity",
        (
            Col("activity_date", "date"),
            *_all("long", "account_id", "character_id"),
            *_all(
                "int",
                "login_count",
                "session_count",
                "play_minutes",
                "combat_minutes",
                "non_combat_minutes",
                "content_attempt_count",
                "boss_attempt_count",
                "enhancement_attempt_count",
                "payment_count",
            ),
            *_all("long", "earned_gold", "spent_gold"),
        ),
        parents=(_ACCOUNT, _CHARACTER),
        time_column="activity_date",
    ),
    Table(
        "content_attempts",
        (
            *_all("long", "attempt_id", "account_id", "character_id", "content_id"),
            _opt("party_id", "long"),
            Col("attempt_started_at", "time"),
            _opt("attempt_ended_at", "time"),
            _text("difficulty", 20),
            _text("result", 20),
            _opt("clear_time_sec", "int"),
            _text("fail_reason", 50, required=False),
            *_all("int", "death_count", "revive_count", "potion_used_count", "party_member_count"),
            _opt("avg_party_combat_power", "long"),
            Col("reward_claimed", "flag"),
        ),
        key=("attempt_id",),
        parents=(_ACCOUNT, _CHARACTER, _CONTENT),
        time_column="attempt_started_at",
    ),
    Table(
        "boss_pattern_logs",
        (
            *_all("long", "pattern_log_id", "attempt_id", "character_id", "content_id"),
            _text("boss_name", 100),
            Col("phase_no", "int"),
            _text("pattern_code", 50),
            _text("pattern_name", 100),
            Col("pattern_started_at", "time"),
            Col("pattern_duration_sec", "int"),
            Col("was_hit", "flag"),
            Col("damage_taken", "long"),
            *_all("flag", "is_fatal", "avoid_success"),
            _text("position_zone", 30, required=False),
        ),
        key=("pattern_log_id",),
        parents=(_ATTEMPT, _CHARACTER, _CONTENT),
        time_column="pattern_started_at",
    ),
    Table(
        "reward_logs",
        (
            Col("reward_id", "long"),
            _opt("attempt_id", "long"),
            *_all("long", "account_id", "character_id"),
            _opt("content_id", "long"),
            Col("rewarded_at", "time"),
            _text("reward_source", 30),
            Col("item_id", "long"),
            _text("item_name", 100),
            _text("item_type", 30),
            _text("item_rarity", 20),
            Col("quantity", "int"),
            _opt("estimated_gold_value", "long"),
            Col("is_first_clear_reward", "flag"),
        ),
        key=("reward_id",),
        parents=(_ATTEMPT, _ACCOUNT, _CHARACTER, _CONTENT),
        time_column="rewarded_at",
    ),
    Table(
        "enhancement_logs",
        (
            *_all("long", "enhancement_id", "account_id", "character_id"),
            Col("enhanced_at", "time"),
            Col("item_id", "long"),
            _text("item_type", 30),
            *_all("int", "before_enhance_level", "after_enhance_level"),
            Col("success_rate", "rate"),
            _text("result", 20),
            Col("gold_cost", "long"),
            _opt("material_item_id", "long"),
            Col("material_count", "int"),
            Col("used_protection_item", "flag"),
            _opt("pity_stack_before", "int"),
        ),
        key=("enhancement_id",),
        parents=(_ACCOUNT, _CHARACTER),
        time_column="enhanced_at",
    ),
    Table(
        "payments",
        (
            *_all("long", "payment_id", "account_id"),
            _opt("character_id", "long"),
            Col("paid_at", "time"),
            Col("product_id", "long"),
            _text("product_name", 100),
            _text("product_type", 30),
            Col("price_krw", "int"),
            _text("currency_code", 3),
            _text("payment_method", 30, required=False),
            _text("payment_status", 20),
            _opt("refund_at", "time"),
            Col("is_first_payment", "flag"),
            _text("linked_event_id", 30, required=False),
        ),
        key=("payment_id",),
        parents=(_ACCOUNT, _CHARACTER),
        time_column="paid_at",
    ),
)

TABLES: dict[str, Table] = {table.name: table for table in _DECLARED}
