"""Stored tables: what a write touches, what a dead or repeated write leaves, and what a derived table computes again."""

import pytest
from pyspark.sql import functions as F

from finstrata.stored import Outrun, StoredTable, Version

SCHEMA = "ticker string, fiscal_year int, revenue double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(t):
    return sorted(map(tuple, t.read().collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path), "financials_annual", 8)
    t.write(frame(spark, [(f"S{k}", y, float(k)) for k in range(40) for y in (2000, 2001)]), "a")
    return t


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.version().folders
    table.write(frame(spark, [("S1", 2001, 9.0), ("S1", 2002, 10.0)]), "b")
    after = table.version().folders
    assert len([b for b in after if after[b] != before[b]]) == 1
    got = {r[:2]: r[2] for r in rows(table)}
    assert len(got) == 81 and got["S1", 2000] == 1.0 and got["S1", 2001] == 9.0 and got["S1", 2002] == 10.0


def test_repeated_batch_changes_nothing(spark, table):
    b = frame(spark, [("S1", 2001, 9.0)])
    v = table.write(b, "b")
    assert table.write(frame(spark, [("S1", 2001, 8.0)]), "b") == v
    assert table.version() == v


def test_dead_write_leaves_the_table(spark, table, monkeypatch):
    before = rows(table)

    def die(self, v):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            table.write(frame(spark, [("S1", 2001, 9.0)]), "b")
    assert rows(table) == before
    table.write(frame(spark, [("S1", 2001, 9.0)]), "b")
    table.vacuum()
    assert ("S1", 2001, 9.0) in rows(table) and len(rows(table)) == len(before)


def test_second_of_two_writers_fails_whole(spark, table, monkeypatch):
    old = table.version()
    table.write(frame(spark, [("S1", 2001, 9.0)]), "b")
    monkeypatch.setattr(StoredTable, "version", lambda self: old)
    with pytest.raises(Outrun):
        table.write(frame(spark, [("S2", 2001, 7.0)]), "c")
    monkeypatch.undo()
    assert ("S1", 2001, 9.0) in rows(table) and ("S2", 2001, 7.0) not in rows(table)


def test_edges(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path), "financials_annual", 4)
    with pytest.raises(ValueError):
        t.read()
    assert t.version() == Version()
    t.write(frame(spark, []), "none")
    assert rows(t) == []
    t.write(frame(spark, [(None, 2000, 1.0), ("A", None, 2.0)]), "nulls")
    t.write(frame(spark, [(None, 2000, 1.0), ("A", 2000, None)]), "again")
    assert rows(t) == sorted([(None, 2000, 1.0), (None, 2000, 1.0), ("A", None, 2.0), ("A", 2000, None)], key=str)
    # A batch of another key type and with a further column: stored types stay, older rows have none of it.
    t.write(frame(spark, [("B", 2000, 3, "x")], "ticker string, fiscal_year long, revenue int, note string"), "wider")
    assert t.read().where("ticker = 'B'").first() == ("B", 2000, 3.0, "x")
    assert t.read().where("ticker = 'A' and note is not null").count() == 0
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path), "financials_annual", 5).version()


def test_replaced_keys_and_hot_key(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path), "holders", 4)
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 50)).alias("ticker"), F.col("id").alias("holder"))
    t.write(hot, "a")
    t.write(frame(spark, [("HOT", -1)], "ticker string, holder long"), "b")
    assert t.read().where("ticker = 'HOT'").collect() == [("HOT", -1)]
    assert t.read().count() == hot.where("ticker <> 'HOT'").count() + 1


def test_refresh_computes_changed_buckets(spark, table, tmp_path):
    d = StoredTable(spark, str(tmp_path), "totals", 8, "ticker")
    seen = []

    def compute(t):
        seen.append(t["annual"].select("ticker").distinct().count())
        return t["annual"].groupBy("ticker").agg(F.sum("revenue").alias("total"))
    assert len(d.refresh({"annual": table}, compute)) == len(table.version().folders)
    assert d.refresh({"annual": table}, compute) == [] and seen == [40]
    table.write(frame(spark, [("S1", 2002, 10.0), ("NEW", 2002, 5.0)]), "b")
    assert len(d.refresh({"annual": table}, compute)) in (1, 2) and seen[1] < 40
    want = {r[0]: r[1] for r in table.read().groupBy("ticker").agg(F.sum("revenue")).collect()}
    assert {r[0]: r[1] for r in d.read().collect()} == want
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path), "other", 4, "ticker").refresh({"annual": table}, compute)
