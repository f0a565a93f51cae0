"""Statements: constraints, changes of tables, parameters, plans, functions of the dialect."""

import json

import pytest

from lattica.engine import ConstraintError, Engine


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def e(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE p (id INTEGER PRIMARY KEY, code TEXT UNIQUE, n INTEGER CHECK (n >= 0 AND n < 100), CONSTRAINT pair UNIQUE (code, n))")
    e.sql("INSERT INTO p VALUES (1, 'a', 5), (2, 'b', 6), (3, NULL, NULL), (4, NULL, 7)")
    yield e
    for name in list(e.tables):
        e.spark.catalog.dropTempView(name)


def test_unique_and_check(e):
    for bad in ("INSERT INTO p VALUES (9, 'a', 1)", "INSERT INTO p VALUES (9, 'c', 100)", "UPDATE p SET code = 'b' WHERE id = 1", "UPDATE p SET n = -1", "INSERT INTO p VALUES (2, 'z', 1)"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    assert len(rows(e.sql("SELECT * FROM p"))) == 4


@pytest.mark.parametrize("action,left", [("CASCADE", [(10, 20), (11, 20), (12, 2)]), ("SET NULL", [(10, None), (11, None), (12, 2)]), ("SET DEFAULT", [(10, 3), (11, 3), (12, 2)]), ("RESTRICT", None), ("NO ACTION", None)])
def test_actions_on_update(e, action, left):
    e.sql(f"CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER DEFAULT 3 REFERENCES p(id) ON DELETE RESTRICT ON UPDATE {action})")
    e.sql("INSERT INTO c VALUES (10, 1), (11, 1), (12, 2)")
    if left is None:
        with pytest.raises(ConstraintError):
            e.sql("UPDATE p SET id = 20 WHERE id = 1")
        assert rows(e.sql("SELECT id FROM p")) == [(1,), (2,), (3,), (4,)]
    else:
        e.sql("UPDATE p SET id = 20 WHERE id = 1")
        assert sorted(map(str, rows(e.sql("SELECT id, p FROM c")))) == sorted(map(str, left))
    with pytest.raises(ConstraintError):
        e.sql("DROP TABLE p")
    with pytest.raises(ConstraintError):
        e.sql("DELETE FROM p WHERE id = 2")


def test_alterations(e):
    with pytest.raises(ConstraintError):
        e.sql("ALTER TABLE p ADD COLUMN code TEXT")
    with pytest.raises(ConstraintError):
        e.sql("ALTER TABLE p RENAME COLUMN code TO n")
    e.sql("CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p(id))")
    e.sql("ALTER TABLE p RENAME COLUMN id TO key")
    e.sql("ALTER TABLE p RENAME TO parents")
    e.sql("INSERT INTO c VALUES (1, 4)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO c VALUES (1, 40)")
    assert rows(e.sql("SELECT key FROM parents")) == [(1,), (2,), (3,), (4,)]
    e.sql("ALTER TABLE parents ADD COLUMN note TEXT DEFAULT 'none'")
    e.sql("INSERT INTO parents (key, code, n) VALUES (5, 'e', 9)")
    assert {r[0] for r in e.sql("SELECT note FROM parents").collect()} == {"none"}


def test_serial_numbers_of_selected_rows(spark, e):
    e.sql("CREATE TABLE s (id SERIAL, v BIGINT)")
    spark.range(40).repartition(3).createOrReplaceTempView("many")
    e.sql("INSERT INTO s (v) SELECT id FROM many")
    e.sql("INSERT INTO s (v) VALUES (100), (101)")
    assert [r[0] for r in rows(e.sql("SELECT id FROM s"))] == list(range(1, 43))


def test_default_word(e):
    e.sql("CREATE TABLE d (id INTEGER, v INTEGER DEFAULT 7)")
    e.sql("INSERT INTO d VALUES (1, DEFAULT), (2, 3)")
    assert rows(e.sql("SELECT * FROM d")) == [(1, 7), (2, 3)]


def test_parameters(e):
    e.sql("PREPARE a AS SELECT id, '$1 :low' AS t FROM p WHERE id > $1 AND id < $2")
    assert rows(e.sql("EXECUTE a (1, 4)")) == [(2, "$1 :low"), (3, "$1 :low")]
    e.sql("PREPARE b AS SELECT id FROM p WHERE id >= :low")
    assert rows(e.sql("EXECUTE b (low => 3)")) == [(3,), (4,)]
    with pytest.raises(ValueError):
        e.sql("EXECUTE b (high => 3)")
    e.sql("PREPARE i AS INSERT INTO p VALUES ($1, 'it''s', 1)")
    e.sql("EXECUTE i (8)")
    assert rows(e.sql("SELECT code FROM p WHERE id = 8")) == [("it's",)]


def test_plan_formats(e):
    nodes = json.loads(e.sql("EXPLAIN FORMAT JSON SELECT id FROM p WHERE n > 1").first()[0])["plan"]
    assert nodes[0]["depth"] == 0 and {"Filter", "Project"} & {n["operator"] for n in nodes}
    assert e.sql("EXPLAIN (FORMAT YAML) SELECT id FROM p").first()[0].startswith("plan:")
    assert e.sql("EXPLAIN FORMAT XML SELECT id FROM p").first()[0].startswith("<plan>")
    assert e.sql("EXPLAIN SELECT id FROM p").count() > 4


def test_functions_of_the_dialect(e):
    got = e.sql("""SELECT LPAD('abcdef', 3), RPAD('ab', 4, '*'), CONCAT('a', NULL, 1), INITCAP('  two   words '), MOD(7, 0), MOD(-7, 3), SQRT(-1), TRUNCATE(-2.7), TRUNC(2.789, 2), ROUND(2.5), SIGN(-3),
        LOG(1), TRIM('  x '), SUBSTRING('hello', 0, 2), POSITION('hello', 'l'), LEN('é'), DATE_ADD('2024-01-31', INTERVAL 1 MONTH), DATE_FORMAT('2024-03-05', '%d.%m.%Y'), YEAR('no date'), HOUR('2024-01-01 13:14:15'),
        EXTRACT(EPOCH FROM TIMESTAMP '1970-01-02 00:00:00'), QUANTUM_SEARCH('Fantasy', 'fan'), 'LPAD(x, 1)'""").first()
    assert got[:8] == ("abcdef", "ab**", "a1", "Two Words", None, -1, None, -2)
    assert [float(x) for x in got[8:12]] == [2.78, 3.0, -1.0, 0.0] and got[12:16] == ("x", "he", 3, 1)
    assert str(got[16])[:10] == "2024-02-29" and got[17:20] == ("05.03.2024", None, 13) and got[20:] == (86400, 1.0, "LPAD(x, 1)")
    now = e.sql("SELECT NOW(), CURDATE(), CURTIME(), LOCALTIME(), UTC_DATE(), UTC_TIME(), UTC_TIMESTAMP(), EPOCH(), YEAR(), CURRENT_DATE, CURRENT_TIMESTAMP").first()
    assert None not in tuple(now) and str(now[0])[:10] == str(now[1]) == str(now[4])


def test_fuzzy_match_of_books(spark, e):
    books = [(1, "Harry Potter", "Fantasy", "A young wizard discovers magic and battles dark forces"), (2, "Der Hobbit", "Fantasy", "Bilbo embarks on an adventure full of magic and danger"), (3, "Die Säulen der Erde", "Historical", "Medieval cathedral building, no magic involved"), (4, "Das Lied von Eis und Feuer", "Fantasy", "Epic fantasy with dragons, magic, and adventure"), (5, "1984", "Dystopian", "A totalitarian future, no fantasy or magic")]
    e.register("books", spark.createDataFrame(books, "id long, title string, genre string, description string"))
    assert [r[0] for r in rows(e.sql("SELECT * FROM books NEUROMATCH 'Fantasy' STRENGTH > 0.8").select("id"))] == [1, 2, 4, 5]
    scores = dict(rows(e.sql("SELECT id, round(NEUROMATCH(description, 'Fantasy Magie Abenteuer'), 3) FROM books")))
    assert scores[4] == 0.444
    assert [r[0] for r in rows(e.sql("SELECT id FROM books WHERE NEUROMATCH(genre, 'fantasi') > 0.5"))] == [1, 2, 4]
    weights = e.sql("SELECT SYNAPTIC_WEIGHT(NULL), SYNAPTIC_WEIGHT(true), SYNAPTIC_WEIGHT(0), SYNAPTIC_WEIGHT('x'), HEBBIAN_LEARNING(0, 0), HEBBIAN_LEARNING('abc', 'abc', 0.5)").first()
    assert tuple(weights)[:3] == (0.0, 1.0, 0.5) and 0 <= weights[3] < 1 and weights[4] == pytest.approx(0.3) and weights[5] == pytest.approx(0.5)


def test_compress_and_learn(e):
    got = e.sql("COMPRESS TABLE p USING DNA").first()
    assert got["row_count"] == 4 and got["letters"] == 4 * got["bytes"] and got["ratio"] == 1.0 and 0 < got["entropy"] <= 2
    assert e.sql("LEARN PATTERN common FROM p FEATURES (code)").first()["frequency"] == 2
    assert e.sql("SELECT * FROM common").count() == 3
