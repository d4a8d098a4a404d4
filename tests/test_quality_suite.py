"""The data-quality suite over every declared table, key and reference, with planted faults."""

from game import make

from playgauge.operators import quality
from playgauge.sources.schemas import TABLES


def planted(spark):
    """Three rows of every table, of which the last two share their key and the last breaks every reference."""
    tables = {}
    for name, table in TABLES.items():
        references = {p.column: 1 for p in table.parents}
        key = table.key[0] if table.key else None
        rows = [{**references, **({key: k} if key else {})} for k in (1, 2, 2)]
        rows[2].update({column: 900 for column in references})
        tables[name] = make(spark, name, rows)
    return tables


def test_keys_of_every_declared_table(spark):
    tables = planted(spark)
    got = sorted(map(tuple, quality.key_duplicates(tables, TABLES).collect()))
    assert got == sorted((name, "2", 2) for name, table in TABLES.items() if table.key) and len(got) == 9
    tables["reward_logs"] = tables["reward_logs"].drop("reward_id")
    assert ("reward_logs", "absent: reward_id", None) in {tuple(r) for r in quality.key_duplicates(tables, TABLES).collect()}


def test_orphan_keys_of_every_reference(spark):
    tables = planted(spark)
    got = {tuple(r) for r in quality.orphan_keys(tables).collect()}
    assert got == {(ref.label, 900, 1) for ref in quality.STANDARD_REFERENCES}
    summed = {tuple(r) for r in quality.orphan_summary(tables).collect()}
    assert summed == {(fk, rows) for fk, _, rows in got}
    assert quality.attempt_orphans(tables).first()["orphan_rows"] == 1


def test_nulls_of_every_declared_column(spark):
    tables = planted(spark)
    whole = {(r["table_name"], r["column_name"]): r for r in quality.null_profiles(tables, TABLES).collect()}
    assert set(whole) == {(name, c.name) for name, table in TABLES.items() for c in table.columns} and len(TABLES) == 10
    assert all(r["row_count"] == 3 and r["null_violations"] == 0 for r in whole.values())
    bare = {name: df.selectExpr("1 AS other") for name, df in tables.items()}
    for r in quality.null_profiles(bare, TABLES).collect():
        column = next(c for c in TABLES[r["table_name"]].columns if c.name == r["column_name"])
        assert r["nulls"] == 3 and r["null_violations"] == 3 * column.required
