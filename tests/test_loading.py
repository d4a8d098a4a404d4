"""Loading in one pass: accepted and quarantined rows, counts by reason, headers that don't fit."""

import pytest
from pyspark.sql import functions as F

from playgauge.sources.loading import judged, load, load_csv, outcome_counts, parse_lines, reason_names
from playgauge.sources.reader import read_csv
from playgauge.sources.schemas import TABLES

TABLE = TABLES["content_design_goals"]
HEADER = ",".join(TABLE.names)
GOOD = ["1,7,hard,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,", '2,8,"easy","S ""one"", first",45.00,92.00,300,18.00,0.50,12000,2026-01-01,2026-06-30']
BAD = {
    "3,9,hard,S1,31.00,abc,600,24.00,4.50,36000,2026-01-01,": ["bad_value:target_clear_rate"],
    "4,,hard,S1,31.00,52.50,600,24.00,4.50,36000,2026-13-01,": ["missing:content_id", "bad_value:valid_from"],
    "6,9,a difficulty name beyond twenty,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,": ["too_long:difficulty"],
    "7,9,hard,S1,31.00,52.50,600,24.00,4.50,36000,2026-01-01,,one too many": ["malformed_row"],
}


def lines_of(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_lines_are_judged(spark):
    rows = judged(parse_lines(lines_of(spark, [*GOOD, *BAD]), TABLE), TABLE).collect()
    assert [r["row"]["goal_id"] for r in rows if r["outcome"] == "accepted"] == [1, 2]
    told = {r["fields"]["goal_id"]: r["reasons"] for r in rows if r["outcome"] == "quarantined"}
    assert told == {line.split(",")[0]: reasons for line, reasons in BAD.items()}
    assert all((r["row"] is None) == (r["reasons"] is not None) == (r["fields"] is not None) for r in rows)


def test_null_and_empty_lines_are_malformed(spark):
    rows = judged(parse_lines(lines_of(spark, [None, ""]), TABLE), TABLE).collect()
    assert [r["outcome"] for r in rows] == ["quarantined"] * 2
    assert all("missing:goal_id" in r["reasons"] for r in rows)


def test_counts_by_reason(spark):
    rows = judged(parse_lines(lines_of(spark, [*GOOD, *BAD, *BAD]), TABLE), TABLE)
    got = {r["outcome"]: r["rows"] for r in outcome_counts(rows, TABLE).collect()}
    want = {"accepted": 2, "quarantined": 8}
    for reasons in BAD.values():
        want |= {reason: 2 for reason in reasons}
    assert got == want and set(want) <= {"accepted", "quarantined", *reason_names(TABLE)}


def test_one_pass_writes_both_and_counts(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    lines = spark.sparkContext.parallelize([*GOOD, *BAD], 3)

    def seen(line):
        read.add(1)
        return (line,)

    rows = judged(parse_lines(spark.createDataFrame(lines.map(seen), "value string"), TABLE), TABLE)
    loaded = load(rows, TABLE, str(tmp_path / "goals"))
    assert read.value == len(GOOD) + len(BAD)  # every line once
    assert loaded.counts == {
        "accepted": 2, "quarantined": 4, "malformed_row": 1, "bad_value:target_clear_rate": 1,
        "missing:content_id": 1, "bad_value:valid_from": 1, "too_long:difficulty": 1,
    }
    assert [f.dataType for f in loaded.accepted.schema] == [f.dataType for f in TABLE.schema]
    assert {r.goal_id for r in loaded.accepted.collect()} == {1, 2}
    assert {r.goal_id for r in loaded.quarantined.collect()} == {"3", "4", "6", "7"}
    assert sorted(p.name for p in (tmp_path / "goals").iterdir() if p.is_dir()) == ["outcome=accepted", "outcome=quarantined"]


def test_empty_input(spark, tmp_path):
    loaded = load(judged(parse_lines(lines_of(spark, []), TABLE), TABLE), TABLE, str(tmp_path / "none"))
    assert loaded.counts == {"accepted": 0, "quarantined": 0}
    assert loaded.accepted.count() == loaded.quarantined.count() == 0


def test_files(spark, tmp_path):
    path = tmp_path / "goals.csv"
    path.write_text("\n".join([HEADER, *GOOD, *BAD]) + "\n", encoding="utf-8")
    loaded = load_csv(spark, TABLE.name, str(path), str(tmp_path / "out"))
    assert (loaded.counts["accepted"], loaded.counts["quarantined"]) == (2, 4)
    assert loaded.accepted.agg(F.sum("goal_id")).first()[0] == 3


@pytest.mark.parametrize("header", [
    ",".join([TABLE.names[1], TABLE.names[0], *TABLE.names[2:]]),
    ",".join(["id", *TABLE.names[1:]]),
    ",".join(TABLE.names[:-1]),
])
def test_other_headers_are_refused(spark, tmp_path, header):
    path = tmp_path / "goals.csv"
    path.write_text("\n".join([header, *GOOD]) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, TABLE.name, str(path)).accepted.collect()
    with pytest.raises(Exception, match="header"):
        load_csv(spark, TABLE.name, str(path), str(tmp_path / "out"))
    named = [TABLE.names[1], TABLE.names[0], *TABLE.names[2:]]
    if header == ",".join(named):
        assert {r.content_id for r in read_csv(spark, TABLE.name, str(path), file_columns=named).accepted.collect()} == {1, 2}
