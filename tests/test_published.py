"""Published result tables, reproduced from rows that are rebuilt from their counts.

Set PLAYGAUGE_PUBLISHED_DIR to a folder with the published CSV tables. A table
is recognised by a header it contains; without the folder the tests are skipped.
"""

import csv
import glob
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from playgauge.functions.labels import HEADERS, VALUES, localize
from playgauge.operators import gap, health, patterns, release, segments, usage
from playgauge.operators.difficulty import difficulty_factors

FOLDER = os.environ.get("PLAYGAUGE_PUBLISHED_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no published tables given")

FOCUS = 23
BANDS = dict(zip(("01", "02", "03", "04", "05"), ("0.5", "0.9", "1.05", "1.15", "1.3")))


def published(*headers):
    for path in glob.glob(os.path.join(FOLDER, "**", "*.csv"), recursive=True):
        with open(path, encoding="utf-8-sig", newline="") as handle:
            rows = list(csv.DictReader(handle))
        if rows and set(headers) <= set(rows[0]):
            return [{k: None if v == "NULL" else v for k, v in row.items()} for row in rows]
    pytest.skip(f"no published table with {headers}")


def english(operator, code=""):
    """Rows of a localized published table under the operator's own column names."""
    names = {v.format(code=code): k for k, v in HEADERS[operator].items()}
    rows = published(*[h for h in names])
    return [{names.get(k, k): v for k, v in row.items()} for row in rows]


def as_text(value):
    return None if value is None else str(value)


def assert_same(df, rows, columns, key):
    got = {tuple(as_text(r[k]) for k in key): r for r in df.collect()}
    assert len(got) == len(rows)
    for row in rows:
        mine = got[tuple(row[k] for k in key)]
        assert {c: as_text(mine[c]) for c in columns} == {c: row[c] for c in columns}


def part(rate, whole):
    """The count behind a published rate."""
    return int((D(rate) * int(whole) / 100).to_integral_value())


def repeated(spark, rows, schema, times):
    """Each row as often as its ``times`` column says, numbered by ``id`` and within itself by ``i``."""
    df = spark.createDataFrame(rows, schema).filter(F.col(times) > 0)
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), times))).withColumn("id", F.monotonically_increasing_id())


def test_usage_from_counts(spark):
    rows = published("usage_failure_segment", "peer_attempt_gap")
    text = {"content_line_name", "content_name", "content_type", "difficulty", "entry_limit_type"}
    given = [
        "content_id", "content_name", "content_type", "difficulty", "active_account_count", "active_character_count",
        "attempt_count", "participant_account_count", "participant_character_count", "clear_count", "fail_count",
        "give_up_count", "disconnect_count", "non_clear_count", "target_participation_rate", "target_clear_rate",
        "avg_clear_time_sec", "target_avg_clear_time_sec",
    ]
    base = spark.createDataFrame([tuple(r[c] for c in given) for r in rows], ", ".join(f"{c} string" for c in given))
    base = base.select(*(F.col(c) if c in text else F.col(c).cast("decimal(18,2)").alias(c) for c in given))
    base = base.withColumns({c: F.col(c).cast("bigint") for c in given if c.endswith("_count") or c == "content_id"})
    result = usage.classify_usage(usage.peer_metrics(usage.usage_metrics(base)))
    derived = [c for c in usage.COLUMNS if c in result.columns and c not in given]
    assert len(derived) == 22
    assert_same(localize(result, "usage_overview"), rows, derived, ["content_id"])
    below = {r.content_id for r in usage.select_below_target(result).collect()}
    assert below == {int(r["content_id"]) for r in rows if D(r["clear_rate_gap_pp"]) < 0}


def test_health_from_attempt_rows(spark):
    rows = published("usage_failure_segment", "peer_attempt_gap")
    outcomes = ("clear", "fail", "give_up", "disconnect")
    counts = [(int(r["content_id"]), o, int(r[f"{o}_count"]), int(r["participant_account_count"]))
              for r in rows for o in outcomes]
    attempts = repeated(spark, counts, "content_id long, result string, n int, people int", "n").selectExpr(
        "content_id", "result", "pmod(id, 50000) AS account_id", "id AS character_id",
        *(f"CAST(0 AS INT) AS {c}" for c in ("clear_time_sec", "death_count", "revive_count", "potion_used_count",
                                             "party_member_count", "reward_claimed")),
    )
    content = spark.createDataFrame([(int(r["content_id"]),) for r in rows], "content_id long").selectExpr(
        "*", *(f"0 AS {c}" for c in health._ATTRIBUTES[1:])
    )
    got = health.content_health(attempts, content)
    assert got.agg(F.sum("total_attempt_count")).first()[0] == 500_000
    assert_same(
        got.withColumnRenamed("total_attempt_count", "attempt_count"),
        rows,
        ["attempt_count", *(f"{o}_rate_pct" for o in outcomes)],
        ["content_id"],
    )


def test_gaps_from_counts(spark):
    rows = published("health_status", "recommended_ready_rate")
    columns = list(rows[0])
    kept = [c for c in columns if c not in ("clear_rate", "fail_rate", "retry_rate", "reward_claim_rate", "health_status")]
    lines = [
        (*(r[c] for c in kept), part(r["clear_rate"], r["total_attempt_count"]),
         part(r["fail_rate"], r["total_attempt_count"]), part(r["retry_rate"], r["participant_character_count"]))
        for r in rows
    ]
    df = spark.createDataFrame(lines, ", ".join(f"{c} string" for c in kept) + ", clear_count long, fail_count long, retry_character_count long")
    text = {"content_name", "content_type", "difficulty"}
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in kept if c not in text})
    df = df.withColumns({c: F.col(c).cast("bigint") for c in kept if c.endswith("_count") and not c.startswith("avg")})
    # Claims are published per clear.
    claims = [(D(r["content_id"]), part(r["reward_claim_rate"], part(r["clear_rate"], r["total_attempt_count"]))) for r in rows]
    claimed = spark.createDataFrame(claims, "content_id decimal(18,2), reward_claimed_count long")
    got = gap.assess_gaps(df.join(claimed, "content_id")).withColumn("content_id", F.col("content_id").cast("int"))
    checked = ["participation_rate", "recommended_ready_rate", "clear_rate", "fail_rate", "retry_rate",
               "reward_claim_rate", "participation_gap", "clear_rate_gap", "clear_time_gap", "health_status"]
    assert_same(got, rows, checked, ["content_id"])


def test_peer_fail_means(spark):
    usage_rows = published("usage_failure_segment", "peer_attempt_gap")
    rows = english("difficulty_factors")
    counts = [
        (int(r["content_id"]), r["difficulty"], o, int(r[f"{o}_count"]))
        for r in usage_rows
        for o in ("clear", "fail", "give_up", "disconnect")
    ]
    attempts = repeated(spark, counts, "content_id long, difficulty string, result string, n int", "n").selectExpr(
        "content_id", "result", "0 AS death_count", "0 AS clear_time_sec"
    )
    content = spark.createDataFrame(
        [(int(r["content_id"]), r["difficulty"], r["content_name"], r["content_type"], int(r["recommended_combat_power"]),
          D(r["target_clear_rate"])) for r in usage_rows],
        "content_id long, difficulty string, content_name string, content_type string, recommended_combat_power long, target_clear_rate decimal(5,2)",
    )
    goals = content.selectExpr(
        "content_id AS goal_id", "content_id", "difficulty", "target_clear_rate", "CAST(1 AS DECIMAL(5,2)) AS target_death_count_avg",
        "1 AS target_avg_clear_time_sec", "DATE'2024-01-01' AS valid_from"
    )
    ids = [int(r["content_id"]) for r in rows]
    got = difficulty_factors(attempts, content.drop("target_clear_rate"), goals, ids)
    checked = ["content_name", "total_attempt_count", "clear_count", "fail_count", "target_clear_rate", "clear_rate_pct",
               "clear_rate_gap_pp", "fail_rate_pct", "difficulty_avg_fail_rate_pct", "fail_rate_gap_pp", "fail_rate_flag"]
    assert_same(got, rows, checked, ["content_id"])


def test_segments_from_attempt_rows(spark):
    rows = english("power_segments")
    labels = VALUES["power_segments"]["power_band"]
    code = {v: k for k, v in labels.items()}
    lines, segment = [], 0
    for r in rows:
        segment += 1
        power = int(int(r["recommended_combat_power"]) * D(BANDS[code[r["power_band"]][:2]]))
        n, people = int(r["attempt_count"]), int(r["character_count"])
        clears, fails = int(r["clear_count"]), int(r["fail_count"])
        for outcome, first, count in (("clear", 0, clears), ("fail", clears, fails), ("give_up", clears + fails, n - clears - fails)):
            lines.append((segment, int(r["content_id"]), int(r["party_size"].rstrip("인")), power, people, outcome, first, count))
    made = repeated(
        spark, lines, "segment long, content_id long, party_member_count int, power long, people int, result string, first int, n int", "n"
    ).withColumn("character_id", F.expr("segment * 1000000 + (first + i - 1) % people"))
    characters = made.selectExpr("character_id", "power AS combat_power").distinct()
    one_per_content = {r["content_id"]: r for r in rows}.values()
    content = spark.createDataFrame(
        [(int(r["content_id"]), r["content_name"], r["difficulty"], int(r["recommended_combat_power"])) for r in one_per_content],
        "content_id long, content_name string, difficulty string, recommended_combat_power long",
    )
    goals = spark.createDataFrame(
        [(int(r["content_id"]), int(r["content_id"]), r["difficulty"], D(r["target_clear_rate"])) for r in one_per_content],
        "goal_id long, content_id long, difficulty string, target_clear_rate decimal(5,2)",
    ).withColumn("valid_from", F.lit("2024-01-01").cast("date"))
    got = localize(segments.power_segments(made, characters, content, goals), "power_segments")
    wanted = published(*HEADERS["power_segments"].values())
    assert got.columns == list(wanted[0])
    assert [[as_text(v) for v in r] for r in got.collect()] == [list(r.values()) for r in wanted]


def focus_tables(spark):
    """Attempts, characters, content and goals of the focus content, one band after another."""
    bands = english("band_performance")
    incidence = {r["power_band"]: r for r in english("pattern_incidence_by_band", "P999")}
    (told,) = english("release_maturity")
    recommended = 68_656_100
    lines = []
    for r in bands:
        n = int(r["attempt_count"])
        clears, fails = part(r["clear_rate_pct"], n), int(incidence[r["power_band"]]["fail_count"])
        give_ups = part(r["give_up_rate_pct"], n)
        power = int(recommended * D(BANDS[r["power_band"][:2]]))
        first = 0
        for outcome, count in (("fail", fails), ("clear", clears), ("give_up", give_ups), ("disconnect", n - fails - clears - give_ups)):
            lines.append((r["power_band"][:2], power, int(r["character_count"]), outcome, first, count,
                          int(incidence[r["power_band"]]["pattern_attempt_count"])))
            first += count
    made = repeated(spark, lines, "band string, combat_power long, people int, result string, first int, n int, incidents int", "n").selectExpr(
        "id AS attempt_id", f"CAST({FOCUS} AS BIGINT) AS content_id", "result", "combat_power",
        "CAST(band AS BIGINT) * 1000000 + (first + i - 1) % people AS character_id", "first + i <= incidents AS incident",
        "0 AS death_count", "0 AS clear_time_sec",
    )
    made = spark.createDataFrame(made.collect(), made.schema)  # fixed ids
    content = spark.createDataFrame(
        [(FOCUS, told["content_name"], told["content_type"], told["difficulty"], recommended)],
        "content_id long, content_name string, content_type string, difficulty string, recommended_combat_power long",
    ).withColumn("release_date", F.lit(told["release_date"]).cast("date"))
    goals = content.selectExpr(
        "1 AS goal_id", "content_id", "difficulty", "CAST(52 AS DECIMAL(5,2)) AS target_clear_rate",
        "CAST(4.5 AS DECIMAL(5,2)) AS target_death_count_avg", "1860 AS target_avg_clear_time_sec", "DATE'2024-01-01' AS valid_from",
    )
    return made, made.select("character_id", "combat_power").distinct(), content, goals


def test_bands_and_incidence(spark):
    attempts, characters, content, goals = focus_tables(spark)
    rows = english("band_performance")
    got = localize(segments.band_performance(attempts, characters, content, goals, FOCUS), "band_performance")
    names = HEADERS["band_performance"]
    got = got.withColumnsRenamed({v: k for k, v in names.items()})
    checked = ["attempt_count", "character_count", "target_clear_rate", "clear_rate_pct", "fail_rate_pct",
               "give_up_rate_pct", "disconnect_rate_pct", "clear_rate_gap_pp", "target_death_count_avg", "target_avg_clear_time_sec"]
    assert_same(got, rows, checked, ["power_band"])

    logs = attempts.filter("incident").selectExpr("attempt_id", "content_id", "'P999' AS pattern_code")
    got = patterns.pattern_incidence_by_band(attempts, characters, content, logs.union(logs), FOCUS, "P999")
    got = localize(got, "pattern_incidence_by_band", code="P999")
    wanted = published("전체 시도 대비 P999 발생률(%)")
    assert got.columns == list(wanted[0])
    assert [[as_text(v) for v in r] for r in got.collect()] == [list(r.values()) for r in wanted]


def test_release(spark):
    attempts, _, content, goals = focus_tables(spark)
    (row,) = english("release_maturity")
    dated = attempts.withColumn(
        "attempt_started_at",
        F.when(F.col("attempt_id") % 2 == 0, F.lit(row["first_attempt_date"])).otherwise(F.lit(row["reference_date"])).cast("timestamp_ntz"),
    )
    got = localize(release.release_maturity(dated, content, goals, FOCUS), "release_maturity")
    wanted = published("운영 판단 기준")[0]
    mine = {c: as_text(v) for c, v in got.first().asDict().items()}
    people = HEADERS["release_maturity"]["character_count"]
    assert {**mine, people: wanted[people]} == wanted


def test_pattern_tables(spark):
    rows = english("pattern_impact")
    lines = []
    for r in rows:
        n, hits, fatal = (int(r[c]) for c in ("exposed_attempt_count", "hit_attempt_count", "fatal_attempt_count"))
        hit_fails = part(r["fail_rate_hit_pct"] or "0", hits)
        avoided_fails = part(r["fail_rate_avoided_pct"] or "0", n - hits)
        base = (int(r["phase_no"]), r["pattern_code"], r["pattern_name"], D(r["avg_damage_when_hit"] or "0"))
        for hit, failed, count in ((1, True, hit_fails), (1, False, hits - hit_fails), (0, True, avoided_fails),
                                   (0, False, n - hits - avoided_fails)):
            lines.append((*base, hit, failed, count, fatal if (hit, failed) == (1, True) else 0))
    made = repeated(
        spark, lines, "phase_no int, pattern_code string, pattern_name string, damage decimal(14,2), was_hit int, failed boolean, n int, fatal int", "n"
    )
    made = spark.createDataFrame(made.collect(), made.schema)
    logs = made.selectExpr(
        "id AS attempt_id", f"{FOCUS} AS content_id", "phase_no", "pattern_code", "pattern_name", "was_hit",
        "CAST(i <= fatal AS INT) AS is_fatal", "damage AS damage_taken",
    )
    attempts = made.selectExpr("id AS attempt_id", f"{FOCUS} AS content_id", "IF(failed, 'fail', 'clear') AS result")
    got = patterns.pattern_impact(logs, attempts, FOCUS)
    assert_same(got, rows, list(rows[0]), ["phase_no", "pattern_code"])
    assert [as_text(r.fail_rate_difference_pp) for r in got.collect()] == [r["fail_rate_difference_pp"] for r in rows]

    (row,) = english("pattern_by_result", "P999")
    n, tries = int(row["pattern_log_count"]), int(row["pattern_attempt_count"])
    logs = spark.range(n).selectExpr(
        f"id % {tries} AS attempt_id", f"{FOCUS} AS content_id", "'P999' AS pattern_code", "1 AS was_hit",
        f"CAST(id < {row['fatal_log_count']} AS INT) AS is_fatal", f"CAST({row['avg_damage']} AS DECIMAL(14,2)) AS damage_taken",
    )
    tried = spark.range(tries).selectExpr("id AS attempt_id", "'fail' AS result")
    assert_same(patterns.pattern_by_result(logs, tried, FOCUS, "P999"), [row], list(row), ["result"])
