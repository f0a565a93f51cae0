"""Files in and out, key-value tables, backups, migrations."""

import json

import pytest

from lattica.engine import ConstraintError, Engine
from lattica.sources import files


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": 1, "b": "x"}\n{"a": "2", "c": 9}\n{"a": "no", "b": null}\nbroken\n')
    got = files.read_json(spark, str(tmp_path / "in.json"), "a long, b string")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "x"), (2, None), (None, None), (None, None)]))
    df = spark.createDataFrame([(1, 'a "q", \n b', None), (2, None, 1.5)], "i long, t string, d double")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert json.loads(files.json_rows(df).orderBy("row").first()[0]) == {"i": 1, "t": 'a "q", \n b', "d": None}
    files.write_csv(df.select("i", "t").where("i = 1"), str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "i long, t string").collect()] == [(1, 'a "q", \n b')]


def test_key_values(spark, tmp_path):
    kv = files.KeyValue(spark, str(tmp_path / "kv"))
    kv.put(spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "key string, value binary"))
    kv.put(spark.createDataFrame([("a", bytearray(b"3"))], "key string, value binary"))
    assert (kv.get("a"), kv.get("b"), kv.get("c")) == (b"3", b"2", None)
    assert sorted((r["key"], bytes(r["value"])) for r in kv.table().collect()) == [("a", b"3"), ("b", b"2")]


def test_backup_and_restore(spark, tmp_path):
    e = Engine(spark)
    e.sql("CREATE TABLE up (id INTEGER PRIMARY KEY, v TEXT)")
    e.sql("CREATE TABLE down (id SERIAL, up INTEGER REFERENCES up(id))")
    e.sql("INSERT INTO up VALUES (1, 'a')")
    e.sql("INSERT INTO down (up) VALUES (1)")
    first = files.backup(e, str(tmp_path / "one"))
    e.sql("INSERT INTO down (up) VALUES (1)")
    second = files.backup(e, str(tmp_path / "two"), str(tmp_path / "one"))
    assert first["up"]["place"] == second["up"]["place"] and first["down"]["place"] != second["down"]["place"]
    e.sql("DELETE FROM down")
    files.restore(e, str(tmp_path / "two"))
    assert sorted(map(tuple, e.sql("SELECT * FROM down").collect())) == [(1, 1), (2, 1)]
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO down (up) VALUES (7)")


def test_migrations(spark):
    e = Engine(spark)
    scripts = [(1, "CREATE TABLE m (id INTEGER); INSERT INTO m VALUES (1)", "DROP TABLE m"), (2, "ALTER TABLE m ADD COLUMN x INTEGER DEFAULT 4", "ALTER TABLE m DROP COLUMN x")]
    assert files.migrate(e, scripts) == [1, 2] and files.migrate(e, scripts) == []
    assert tuple(e.sql("SELECT * FROM m").first()) == (1, 4)
    assert files.migrate(e, scripts, 0) == [2, 1] and "m" not in e.tables
    with pytest.raises(Exception):
        files.migrate(e, [(3, "CREATE TABLE k (id INTEGER); INSERT INTO nowhere VALUES (1)", "")])
    assert "k" not in e.tables
