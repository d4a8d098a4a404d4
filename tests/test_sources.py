"""CSV loading with quarantine, table layout, result export."""

from datetime import date, datetime
from decimal import Decimal as D

import game
import pytest
from physical import plan_of
from pyspark.sql import functions as F

from playgauge.config import DEFAULT
from playgauge.functions.labels import HEADERS, VALUES, localize
from playgauge.functions.period import DAY_COLUMN, in_period
from playgauge.operators import patterns
from playgauge.sources.reader import load_report, read_csv, read_table, read_tables, schema_report
from playgauge.sources.schemas import TABLES
from playgauge.sources.writer import compact_days, write_bucketed, write_days, write_result, write_table

GOALS = """goal_id,content_id,difficulty,season_id,target_participation_rate,target_clear_rate,\
target_avg_clear_time_sec,target_retry_rate,target_death_count_avg,target_reward_value,valid_from,valid_to
1,7,hard,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,
2,8,"easy","S ""one"", first",45.00,92.00,300,18.00,0.50,12000,2026-01-01,2026-06-30
3,9,hard,S1,31.00,abc,600,24.00,4.50,36000,2026-01-01,""
4,,hard,S1,31.00,52.50,600,24.00,4.50,36000,2026-13-01,
5,9,hard,S1,31.00
6,9,a difficulty name beyond twenty,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,
7,9,,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,""
"""


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_is_typed_and_bad_rows_are_kept_apart(spark, tmp_path):
    load = read_csv(spark, "content_design_goals", _file(tmp_path, "goals.csv", GOALS))
    declared = TABLES["content_design_goals"].schema
    assert [f.dataType for f in load.accepted.schema] == [f.dataType for f in declared]
    good = {r.goal_id: r for r in load.accepted.collect()}
    assert set(good) == {1, 2, 7}
    assert good[1].target_clear_rate == D("52.50") and good[1].valid_to is None
    assert good[2].season_id == 'S "one", first' and good[2].valid_to == date(2026, 6, 30)
    assert good[7].difficulty == ""  # a required text may be empty, a number may not
    bad = {r.goal_id: r.reasons for r in load.rejected.collect()}
    assert bad["3"] == ["bad_value:target_clear_rate"]
    assert bad["4"] == ["missing:content_id", "bad_value:valid_from"]
    assert "malformed_row" in bad["5"]
    assert bad["6"] == ["too_long:difficulty"]


def test_csv_column_order(spark, tmp_path):
    order = ["country_code", "account_id", "created_at", "last_login_at", "signup_channel", "platform",
             "account_status", "is_tester", "marketing_opt_in"]
    text = ",".join(order) + "\nKR,5,2026-01-02 03:04:05,,web,pc,active,0,\n"
    path = _file(tmp_path, "accounts.csv", text)
    row = read_csv(spark, "accounts", path, file_columns=order).accepted.first()
    assert (row.account_id, row.country_code, row.last_login_at) == (5, "KR", None)
    assert row.created_at == datetime(2026, 1, 2, 3, 4, 5)
    with pytest.raises(ValueError):
        read_csv(spark, "accounts", path, file_columns=order[1:])


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    header = ",".join(TABLES["accounts"].names)
    path = _file(tmp_path, "a.csv", header + '\n1,2026-01-01 00:00:00,,"we\nb",pc,KR,active,0,1\n')
    row = read_csv(spark, "accounts", path, multiline=True).accepted.first()
    assert row.signup_channel == "we\nb"


def test_every_table_round_trips_through_csv(spark, tmp_path):
    for name, table in TABLES.items():
        df = game.make(spark, name, [{}])
        df.write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
        loaded = read_table(spark, name, str(tmp_path / f"{name}.csv"), "csv")
        assert [f.dataType for f in loaded.schema] == [f.dataType for f in table.schema]
        assert loaded.collect() == df.collect(), name
    tables = read_tables(spark, str(tmp_path), "csv")
    assert list(tables) == list(TABLES)
    with pytest.raises(ValueError):
        read_table(spark, "accounts", str(tmp_path), "orc")


def test_rejected_rows_are_not_lost_in_silence(spark, tmp_path):
    header = ",".join(TABLES["accounts"].names)
    rows = ["1,2026-01-01 00:00:00,,web,pc,KR,active,0,1", "x,2026-01-01 00:00:00,,web,pc,KR,active,0,", "3,,,web,pc,KR,active,0,1"]
    path = _file(tmp_path, "a.csv", "\n".join([header, *rows]) + "\n")
    for whole in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("platform").collect()):
        with pytest.raises(Exception, match="rejected row"):
            whole(read_table(spark, "accounts", path, "csv"))
    assert [r.account_id for r in read_table(spark, "accounts", path, "csv", rejected="drop").collect()] == [1]
    counts = {r.outcome: r.rows for r in load_report("accounts", read_csv(spark, "accounts", path)).collect()}
    assert counts["accepted"] == 1 and counts["rejected"] == 2
    assert counts["bad_value:account_id"] == 1 and counts["missing:created_at"] == 1
    with pytest.raises(ValueError):
        read_table(spark, "accounts", path, "csv", rejected="keep")


def test_parquet_is_held_against_the_declaration(spark, tmp_path):
    df = game.make(spark, "accounts", [{}])
    odd = df.drop("platform").withColumn("account_id", F.col("account_id").cast("string")).withColumn("more", F.lit(1))
    report = schema_report(odd, TABLES["accounts"])
    assert report == {"missing": ["platform"], "extra": ["more"], "type": ["account_id: string, declared bigint"]}
    odd.write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="platform"):
        read_table(spark, "accounts", str(tmp_path / "odd"))


def test_day_layout_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "attempts")
    write_table(game.attempts(spark), "content_attempts", path)
    loaded = read_table(spark, "content_attempts", path)
    assert loaded.count() == 9 and DAY_COLUMN in loaded.columns
    kept = in_period(loaded, "attempt_started_at", F.lit(date(2026, 6, 1)), F.lit(date(2026, 6, 30)))
    assert kept.count() == 1
    assert "PartitionFilters: [isnotnull(event_day" in plan_of(kept)
    write_table(game.goals(spark), "content_design_goals", str(tmp_path / "goals"))
    assert spark.read.parquet(str(tmp_path / "goals")).count() == 6


def test_bucketed_tables_join_without_a_shuffle(spark):
    write_bucketed(game.attempts(spark), "bucketed_attempts", "attempt_id", 4)
    write_bucketed(game.patterns(spark), "bucketed_patterns", "attempt_id", 4)
    try:
        a, p = spark.table("bucketed_attempts"), spark.table("bucketed_patterns")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        per_attempt = patterns.pattern_attempts(p, a, 1, DEFAULT.outcomes)
        assert "Exchange" not in plan_of(per_attempt)
        assert per_attempt.count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_attempts")
        spark.sql("DROP TABLE bucketed_patterns")


def test_result_export(spark, tmp_path):
    impact = patterns.pattern_impact(game.patterns(spark), game.attempts(spark), 1)
    path = tmp_path / "impact"
    write_result(localize(impact, "pattern_impact").coalesce(1), str(path))
    (part,) = path.glob("part-*.csv")
    lines = part.read_text(encoding="utf-8").splitlines()
    assert lines[0].split(",")[:3] == ["페이즈", "패턴 코드", "패턴명"]
    assert lines[1] == "1,P1,P1,3,2,66.67,1,33.33,27.50,33.33,50.00,0.00,50.00"
    assert "NULL" in lines[-1]
    other = tmp_path / "renamed"
    write_result(impact.select("phase_no").limit(1), str(other), headers={"phase_no": "phase"})
    assert next(other.glob("part-*.csv")).read_text().splitlines()[0] == "phase"


def test_localized_values(spark):
    df = spark.createDataFrame([("01_under_80",), ("05_120_and_over",)], "power_band string")
    got = [r[0] for r in localize(df, "power_segments").collect()]
    assert got == ["권장 전투력 80% 미만", "권장 전투력 120% 이상"]
    named = localize(spark.createDataFrame([(1,)], "pattern_log_count int"), "pattern_by_result", code="P999")
    assert named.columns == ["P999 로그 수"]
    assert set(VALUES) - set(HEADERS) == {"usage_overview"}


def test_a_day_loaded_twice_stays_one_copy(spark, tmp_path):
    path = str(tmp_path / "attempts")
    attempts = game.attempts(spark)
    write_table(attempts, "content_attempts", path)
    days = [r[0] for r in attempts.select(F.to_date("attempt_started_at")).distinct().orderBy(1).collect()]
    again = in_period(attempts, "attempt_started_at", days[0], days[0]).withColumn("death_count", F.lit(77))
    for _ in range(2):
        write_days(again, "content_attempts", path)
        stored = spark.read.parquet(path)
        assert stored.count() == attempts.count()
        deaths = {r[0]: r[1] for r in stored.groupBy(F.to_date("attempt_started_at")).agg(F.min("death_count")).collect()}
        assert deaths[days[0]] == 77 and all(n != 77 for day, n in deaths.items() if day != days[0])


def test_days_are_compacted(spark, tmp_path):
    path = str(tmp_path / "attempts")
    attempts = game.attempts(spark)
    attempts.repartition(8).withColumn(DAY_COLUMN, F.to_date("attempt_started_at")).write.partitionBy(DAY_COLUMN).parquet(path)
    before = len(spark.read.parquet(path).inputFiles())
    days = [r[0] for r in attempts.select(F.to_date("attempt_started_at")).distinct().orderBy(1).collect()]
    compact_days(spark, "content_attempts", path, days[0], days[-1])
    after = spark.read.parquet(path)
    assert len(after.inputFiles()) == len(days) < before
    assert sorted(map(str, after.select(*attempts.columns).collect())) == sorted(map(str, attempts.collect()))


def test_dimensions_have_no_days(spark, tmp_path):
    path = tmp_path / "characters"
    write_table(game.characters(spark), "characters", str(path))
    assert not [p for p in path.iterdir() if p.is_dir()]
    with pytest.raises(ValueError):
        write_days(game.characters(spark), "characters", str(path))
