import pytest

from lattica.engine import ConstraintError, Engine
from lattica.functions import dna, scalar
from lattica.operators import recursion
from lattica.streaming.windows import topic


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_statements(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE parents (id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    e.sql("CREATE TABLE kids (id SERIAL, parent INTEGER REFERENCES parents(id) ON DELETE CASCADE, age INTEGER DEFAULT 7)")
    e.sql("INSERT INTO parents VALUES (1, 'a'), (2, 'b')")
    e.sql("INSERT INTO kids (parent) VALUES (1), (1), (2)")
    assert ids(e.sql("SELECT id FROM kids WHERE age = 7")) == [1, 2, 3]
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO kids (parent) VALUES (9)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO parents VALUES (1, 'c')")
    e.sql("BEGIN")
    e.sql("DELETE FROM parents WHERE id = 1")
    assert ids(e.sql("SELECT id FROM kids")) == [3]
    e.sql("ROLLBACK")
    assert ids(e.sql("SELECT id FROM kids")) == [1, 2, 3]
    e.sql("ALTER TABLE kids ADD COLUMN grade INTEGER DEFAULT 3")
    e.sql("UPDATE kids SET grade = grade + age WHERE parent = 1")
    assert sorted(tuple(r) for r in e.sql("SELECT id, grade FROM kids").collect()) == [(1, 10), (2, 10), (3, 3)]


def test_match(spark):
    e = Engine(spark)
    books = [(1, "Harry Potter", "Fantasy", "A young wizard discovers magic and battles dark forces"), (5, "1984", "Dystopian", "Totalitarian future")]
    e.register("books", spark.createDataFrame(books, "id long, title string, genre string, description string"))
    assert ids(e.sql("SELECT * FROM books NEUROMATCH 'Fantasy' STRENGTH > 0.8").select("id")) == [1]


def test_recursion_depth(spark):
    ring = spark.createDataFrame([(i, i % 20 + 1) for i in range(1, 21)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert recursion.closure(start, ring).count() == 20
    assert recursion.closure(start, ring, distinct=False, guard="depth < 5").count() == 6
    with pytest.raises(RecursionError):
        recursion.closure(start, ring, distinct=False, max_depth=3)


def test_functions(spark):
    row = spark.createDataFrame([("Hi", "  two   words ")], "a string, b string")
    assert row.select(dna.encode(row.a), scalar.initcap(row.b), dna.decode(dna.encode(row.a)).cast("string"), scalar.lpad(row.a, 4, "x")).first() == ("TAGATGGT", "Two Words", "Hi", "xxHi")
    import re

    assert re.match(topic("a.*.c"), "a.b.c") and not re.match(topic("a.*.c"), "a.b.b.c") and re.match(topic("a.**"), "a.b.c")
