"""A SQL engine over named tables: statements of the dialect go to DataFrame operations, all other text to Spark SQL.

Tables are immutable DataFrames; a statement that changes one writes a new Parquet version of it into the shared folder and
puts that in its place, so lineages stay short, a transaction is a copy of the table map and a savepoint another.
Constraints (primary key, unique, check, not null, foreign keys with their actions on delete and update) are checked by
aggregation and anti-joins. Functions of the dialect are rewritten to built-in ones (dialect.py).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import outside_quotes, rewritten
from .dialect import split as _split
from .functions import dna, neuro
from .storage import Versions

# Type names and the Spark types that hold them.
TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "SMALLINT": "bigint", "SERIAL": "bigint", "BIGSERIAL": "bigint", "SMALLSERIAL": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp", "BLOB": "binary"}


class ConstraintError(ValueError):
    """A statement would break a constraint."""


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Table:
    df: DataFrame
    key: str | None = None
    auto: str | None = None
    next_id: int = 1
    not_null: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    foreign: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()


_ACTION = r"(CASCADE|RESTRICT|NO\s+ACTION|SET\s+NULL|SET\s+DEFAULT)"


def _actions(rest: str) -> dict:
    """on_delete and on_update of a reference's text."""
    found = {k: re.search(rf"ON\s+{k}\s+{_ACTION}", rest, re.I) for k in ("DELETE", "UPDATE")}
    return {f"on_{k.lower()}": re.sub(r"\s+", " ", m[1]).upper() for k, m in found.items() if m}


def _inside(text: str, word: str) -> str | None:
    """What stands in the parentheses behind a word, or None."""
    m = re.search(rf"\b{word}\s*\(", text, re.I)
    if not m:
        return None
    depth, at = 1, m.end()
    while depth and at < len(text):
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
    return text[m.end() : at - 1]


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.snapshots: list[tuple[str, dict[str, Table]]] = []
        self.prepared: dict[str, str] = {}
        self.versions = Versions(spark, "engine")

    def register(self, name: str, df: DataFrame, **constraints) -> None:
        self._put(name, Table(df, **constraints))

    def _written(self, name: str, t: Table) -> Table:
        return replace(t, df=self.versions.write(t.df, name))

    def _put(self, name: str, t: Table) -> None:
        self.tables[name] = t
        t.df.createOrReplaceTempView(name)

    def _restore(self, tables: dict[str, Table]) -> None:
        for name in set(self.tables) - set(tables):
            self.spark.catalog.dropTempView(name)
        self.tables = {}
        for name, t in tables.items():
            self._put(name, t)

    def sql(self, text: str, args=None) -> DataFrame | None:
        """Run one statement; queries give a DataFrame, others None."""
        text = text.strip().rstrip(";")
        for pattern, run in self._STATEMENTS:
            if m := re.fullmatch(pattern, text, re.I | re.S):
                return run(self, *m.groups())
        return self._select(text, args)

    # queries
    def _select(self, text: str, args=None) -> DataFrame:
        m = re.fullmatch(r"(.*?)\bNEUROMATCH\s*(?:\(\s*(?:(\w+)\s*,\s*)?'((?:[^']|'')*)'\s*\)|'((?:[^']|'')*)')(?:\s+STRENGTH\s*>\s*([\d.]+))?\s*((?:ORDER\s+BY|LIMIT).*)?", text, re.I | re.S)
        if m and re.search(r"\bFROM\s+\w+", m[1], re.I):
            base, name, one, two, strength, rest = m.groups()
            found = neuro.neuromatch_filter(self.spark.sql(rewritten(re.sub(r"\b(WHERE|AND)\s*$", "", base.strip(), flags=re.I))), (one if one is not None else two).replace("''", "'"), name, float(strength or neuro.DEFAULT_STRENGTH))
            view = f"matched_{uuid.uuid4().hex}"
            if rest:
                found.createOrReplaceTempView(view)
                return self.spark.sql(f"SELECT * FROM {view} {rest}")
            return found
        text = rewritten(text)
        return self.spark.sql(text, args) if args else self.spark.sql(text)

    def _join(self, left, right, using):
        return self.spark.table(left).join(self.spark.table(right), using.split(","))

    def _explain(self, how, text):
        """The plan as lines of text, or in one row as JSON, YAML or XML: a list of nodes with their depth."""
        execution = self.sql(text)._jdf.queryExecution()
        form = re.search(r"FORMAT\s+(\w+)", how or "", re.I)
        form = form[1].upper() if form else "TEXT"
        if form == "TEXT":
            return self.spark.createDataFrame([(line,) for line in execution.toString().splitlines()], "plan string")
        nodes = []
        for line in execution.optimizedPlan().toString().splitlines():
            bare = line.lstrip(" :+-!")
            nodes.append({"depth": (len(line) - len(bare)) // 3, "operator": bare.split(" ")[0].split("(")[0], "detail": bare})
        escaped = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        made = {
            "JSON": lambda: json.dumps({"plan": nodes}),
            "YAML": lambda: "plan:\n" + "\n".join(f"  - depth: {n['depth']}\n    operator: {n['operator']}\n    detail: {json.dumps(n['detail'])}" for n in nodes),
            "XML": lambda: "<plan>" + "".join(f'<node depth="{n["depth"]}" operator="{escaped(n["operator"])}">{escaped(n["detail"])}</node>' for n in nodes) + "</plan>",
        }
        if form not in made:
            raise ValueError(f"no plan format {form}")
        return self.spark.createDataFrame([(made[form](),)], "plan string")

    def _compress(self, name):
        """What the letters of a table's rows (as JSON texts) take: rows, bytes, letters, the ratio at two bits a letter, bits a letter."""
        rows = self.tables[name].df.select(F.to_json(F.struct("*")).alias("row"))
        coded = rows.select(F.octet_length("row").alias("n"), dna.encode(F.col("row")).alias("s"))
        count = lambda b: F.sum(F.length("s") - F.length(F.replace("s", F.lit(b), F.lit("")))).alias(b)
        all_of_it = coded.agg(F.count("*").alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("letters"), *map(count, dna.BASES))
        part = lambda b: F.when(F.col(b) > 0, -F.col(b) / F.col("letters") * F.log2(F.col(b) / F.col("letters"))).otherwise(F.lit(0.0))
        return all_of_it.select(F.lit(name).alias("table"), "row_count", "bytes", "letters", F.round(F.col("letters") / 4 / F.nullif("bytes", F.lit(0)), 6).alias("ratio"), F.round(part("A") + part("T") + part("G") + part("C"), 6).alias("entropy"))

    def _learn(self, name, source, columns):
        """The most frequent combinations of a table's columns, as a view of the pattern's name."""
        df = self.spark.table(source)
        by = [c.strip() for c in columns.split(",")] if columns else df.columns
        found = df.groupBy(*by).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), *by).limit(100)
        found.createOrReplaceTempView(name)
        return found

    def _analyze(self, name):
        df = self.tables[name].df
        return df.agg(F.lit(name).alias("table"), F.count("*").alias("row_count"), *[F.approx_count_distinct(c).alias(f"distinct_{c}") for c in df.columns])

    # definitions
    def _create(self, name, body):
        columns, key, auto, not_null, defaults, foreign, unique, checks = [], None, None, [], {}, [], [], []
        names = lambda s: tuple(c.strip() for c in s.split(","))
        for part in _split(body):
            own = re.sub(r"^CONSTRAINT\s+\w+\s+", "", part, flags=re.I)
            if m := re.match(r"PRIMARY\s+KEY\s*\(([\w\s,]+)\)", own, re.I):
                held = names(m[1])
                key = held[0] if len(held) == 1 else key
                not_null += held
                unique += [held] if len(held) > 1 else []
                continue
            if m := re.match(r"UNIQUE\s*(?:KEY\s*)?\(([\w\s,]+)\)", own, re.I):
                unique.append(names(m[1]))
                continue
            if re.match(r"CHECK\s*\(", own, re.I):
                checks.append(_inside(own, "CHECK"))
                continue
            if m := re.match(r"FOREIGN\s+KEY\s*\((\w+)\)\s*REFERENCES\s+(\w+)\s*\((\w+)\)(.*)", own, re.I | re.S):
                foreign.append(ForeignKey(m[1], m[2], m[3], **_actions(m[4])))
                continue
            m = re.match(r"(\w+)\s+(\w+)\s*(\([\d\s,]+\))?(.*)", own, re.S)
            kind = f"decimal{m[3]}" if m[2].upper() in ("DECIMAL", "NUMERIC") and m[3] else TYPES.get(m[2].upper(), "decimal(18,4)")
            columns.append((m[1], kind))
            check = _inside(m[4], "CHECK")
            if check is not None:
                checks.append(check)
            rest = m[4].upper()
            key = m[1] if "PRIMARY KEY" in rest else key
            auto = m[1] if "SERIAL" in m[2].upper() or "AUTO_INCREMENT" in rest or "IDENTITY" in rest else auto
            if "NOT NULL" in rest:
                not_null.append(m[1])
            if re.search(r"\bUNIQUE\b", rest):
                unique.append((m[1],))
            if d := re.search(r"DEFAULT\s+('(?:[^']|'')*'|\S+)", m[4], re.I):
                defaults[m[1]] = d[1]
            if r := re.search(r"REFERENCES\s+(\w+)\s*\((\w+)\)(.*)", m[4], re.I | re.S):
                foreign.append(ForeignKey(m[1], r[1], r[2], **_actions(r[3])))
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in columns])
        self._put(name, Table(self.spark.createDataFrame([], schema), key, auto, 1, tuple(not_null), defaults, tuple(foreign), tuple(unique), tuple(checks)))

    def _create_if(self, name, body):
        if name not in self.tables:
            self._create(name, body)

    def _drop(self, exists, name):
        if name not in self.tables:
            if exists:
                return
            raise ValueError(f"no table {name}")
        if children := self._children(name):
            raise ConstraintError(f"{children[0][0]} refers to {name}")
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def _children(self, name) -> list[tuple[str, ForeignKey]]:
        """Other tables' foreign keys that refer to a table."""
        return [(child, k) for child, c in self.tables.items() for k in c.foreign if k.parent == name and child != name]

    def _truncate(self, name, restart=None):
        t = self.tables[name]
        self._put(name, replace(t, df=t.df.limit(0), next_id=1 if restart else t.next_id))

    def _add(self, name, column, kind, rest):
        t = self.tables[name]
        if column.lower() in (c.lower() for c in t.df.columns):
            raise ConstraintError(f"{name} has a column {column}")
        d = re.search(r"DEFAULT\s+('(?:[^']|'')*'|\S+)", rest or "", re.I)
        new = replace(t, df=t.df.withColumn(column, F.expr(d[1] if d else "null").cast(TYPES.get(kind.upper(), kind.lower()))))
        new = replace(new, defaults=t.defaults | ({column: d[1]} if d else {}), not_null=t.not_null + ((column,) if re.search(r"NOT\s+NULL", rest or "", re.I) else ()))
        self._changed(name, new)

    def _drop_column(self, name, column):
        t = self.tables[name]
        if column not in t.df.columns:
            raise ValueError(f"{name} has no column {column}")
        if column == t.key:
            raise ConstraintError("the primary key stays")
        if any(k.parent_column == column for _, k in self._children(name)):
            raise ConstraintError(f"{name}.{column} is referred to")
        if any(re.search(rf"\b{column}\b", c, re.I) for c in t.checks):
            raise ConstraintError(f"a check needs {column}")
        keep = lambda names: tuple(n for n in names if n != column)
        unique = tuple(u for u in t.unique if column not in u)
        self._put(name, replace(t, df=t.df.drop(column), auto=None if t.auto == column else t.auto, not_null=keep(t.not_null), defaults={k: v for k, v in t.defaults.items() if k != column}, unique=unique, foreign=tuple(k for k in t.foreign if k.column != column)))

    def _rename(self, name, old, new):
        t = self.tables[name]
        if old not in t.df.columns:
            raise ValueError(f"{name} has no column {old}")
        if new.lower() in (c.lower() for c in t.df.columns if c != old):
            raise ConstraintError(f"{name} has a column {new}")
        own = lambda c: new if c == old else c
        checks = tuple(re.sub(rf"\b{old}\b", new, c) for c in t.checks)
        self._put(name, replace(t, df=t.df.withColumnRenamed(old, new), key=own(t.key), auto=own(t.auto), not_null=tuple(map(own, t.not_null)), defaults={own(k): v for k, v in t.defaults.items()}, unique=tuple(tuple(map(own, u)) for u in t.unique), foreign=tuple(replace(k, column=own(k.column)) for k in t.foreign), checks=checks))
        self._refer(name, lambda k: replace(k, parent_column=own(k.parent_column)))

    def _rename_table(self, name, new):
        if new in self.tables:
            raise ConstraintError(f"there is a table {new}")
        self._put(new, self.tables.pop(name))
        self.spark.catalog.dropTempView(name)
        self._refer(name, lambda k: replace(k, parent=new))

    def _refer(self, parent, change) -> None:
        """Foreign keys that refer to a table, changed."""
        for child, c in list(self.tables.items()):
            if any(k.parent == parent for k in c.foreign):
                self.tables[child] = replace(c, foreign=tuple(change(k) if k.parent == parent else k for k in c.foreign))

    def _modify(self, name, column, kind):
        t = self.tables[name]
        self._put(name, replace(t, df=t.df.withColumn(column, F.col(column).cast(TYPES.get(kind.upper(), kind.lower())))))

    # changes
    def _check(self, t: Table) -> None:
        for c in {*t.not_null, *([t.key] if t.key else [])}:
            if not t.df.where(F.col(c).isNull()).isEmpty():
                raise ConstraintError(f"{c} is null")
        for held in (*t.unique, *([(t.key,)] if t.key else [])):
            # rows with a null are never equal
            filled = t.df.where(" and ".join(f"`{c}` is not null" for c in held))
            if not filled.groupBy(*held).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{', '.join(held)} is not unique")
        for check in t.checks:
            if not t.df.where(~F.coalesce(F.expr(rewritten(check)), F.lit(True))).isEmpty():
                raise ConstraintError(f"a row breaks {check}")
        for k in t.foreign:
            parent = self.tables[k.parent].df.select(F.col(k.parent_column).alias("__p"))
            if not t.df.where(F.col(k.column).isNotNull()).join(parent, F.col(k.column) == F.col("__p"), "left_anti").isEmpty():
                raise ConstraintError(f"{k.column} refers to nothing in {k.parent}")

    def _values(self, t: Table, given: list[str], rows: list[str]) -> DataFrame:
        """Rows of literal values; the word DEFAULT stands for the column's default."""
        own = lambda c, v: t.defaults.get(c, "null") if v.upper() == "DEFAULT" else v
        tuples = [", ".join(f"CAST({rewritten(own(c, v))} AS {t.df.schema[c].dataType.simpleString()})" for c, v in zip(given, _split(r[1:-1]), strict=True)) for r in rows]
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(f'({x})' for x in tuples)} AS v({', '.join(given)})").coalesce(1)

    def _insert(self, name, columns, values):
        t = self.tables[name]
        given = [c.strip() for c in columns.split(",")] if columns else [c for c in t.df.columns if c != t.auto or len(_split(_split(values)[0][1:-1])) == len(t.df.columns)]
        if values.upper().startswith("VALUES"):
            values = values[6:].strip()
            rows = self._values(t, given, _split(values))
        else:
            rows = self.sql(values).toDF(*given)
        next_id = t.next_id
        if t.auto and t.auto not in given:
            rows, n = self._numbered(rows, t.auto, next_id)
            next_id += n
        full = rows.select(*[(F.col(c) if c in rows.columns else F.expr(t.defaults.get(c, "null"))).cast(t.df.schema[c].dataType).alias(c) for c in t.df.columns])
        self._changed(name, replace(t, df=t.df.unionByName(full), next_id=next_id))

    def _numbered(self, rows: DataFrame, column: str, first: int) -> tuple[DataFrame, int]:
        """Rows with numbers in sequence from `first` on, and how many: places in their partitions behind the partitions' sizes."""
        fixed = self.versions.write(rows.withColumn("__at", F.monotonically_increasing_id()), "rows")  # numbered once
        part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = sorted((r["p"], r["n"]) for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
        starts, total = {}, 0
        for p, n in sizes:
            starts[p], total = total, total + n
        if not sizes:
            return rows.withColumn(column, F.lit(None).cast("long")), 0
        before = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[part]
        return fixed.withColumn(column, before + place + first).drop("__at"), total

    def _changed(self, name, t: Table) -> None:
        t = self._written(name, t)
        self._check(t)
        self._put(name, t)

    def _update(self, name, sets, where):
        t = self.tables[name]
        hit = F.coalesce(F.expr(rewritten(where)), F.lit(False)) if where else F.lit(True)
        new = dict(re.split(r"\s*=\s*", s, maxsplit=1) for s in _split(sets))
        value = lambda c: F.expr(rewritten(new[c])).cast(t.df.schema[c].dataType)
        after = replace(t, df=t.df.select(*[F.when(hit, value(c)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in t.df.columns]))
        before = dict(self.tables)
        try:
            after = self._written(name, after)
            self._put(name, after)
            for child, k in self._children(name):
                if k.parent_column in new:
                    moved = t.df.where(hit).select(F.col(k.parent_column).alias("__old"), value(k.parent_column).alias("__new")).where("not (__old <=> __new)")
                    self._follow(child, k, self.versions.write(moved, "moved"))
            self._check(after)
            for child, _ in self._children(name):
                self._check(self.tables[child])
        except Exception:
            self._restore(before)
            raise

    def _follow(self, child: str, k: ForeignKey, moved: DataFrame) -> None:
        """What a foreign key's action on update makes of the rows that referred to changed keys (__old, __new)."""
        c = self.tables[child]
        on = F.col(k.column) == F.col("__old")
        if k.on_update in ("RESTRICT", "NO ACTION"):
            if not c.df.join(moved, on, "left_semi").isEmpty():
                raise ConstraintError(f"{child}.{k.column} refers to changed rows of {k.parent}")
            return
        to = {"CASCADE": F.col("__new"), "SET NULL": F.lit(None), "SET DEFAULT": F.expr(c.defaults.get(k.column, "null"))}[k.on_update]
        met = c.df.join(moved, on, "left")
        own = F.when(F.col("__old").isNotNull(), to.cast(c.df.schema[k.column].dataType)).otherwise(F.col(k.column)).alias(k.column)
        self._put(child, self._written(child, replace(c, df=met.select(*[own if x == k.column else F.col(x) for x in c.df.columns]))))

    def _delete(self, name, where):
        t = self.tables[name]
        hit = F.coalesce(F.expr(rewritten(where)), F.lit(False)) if where else F.lit(True)
        self._remove(name, t.df.where(hit), t.df.where(~hit))

    def _remove(self, name, gone: DataFrame, rest: DataFrame) -> None:
        for child, c in list(self.tables.items()):
            for k in c.foreign:
                if k.parent != name:
                    continue
                keys = gone.select(F.col(k.parent_column).alias("__p")).distinct()
                on = F.col(k.column) == F.col("__p")
                if k.on_delete in ("RESTRICT", "NO ACTION"):
                    if not c.df.join(keys, on, "left_semi").isEmpty():
                        raise ConstraintError(f"{child}.{k.column} refers to rows of {name}")
                elif k.on_delete == "CASCADE":
                    self._remove(child, c.df.join(keys, on, "left_semi"), c.df.join(keys, on, "left_anti"))
                else:
                    to = F.expr(c.defaults.get(k.column, "null")) if k.on_delete == "SET DEFAULT" else F.lit(None)
                    hit = c.df.join(keys, on, "left")
                    self._put(child, replace(c, df=hit.withColumn(k.column, F.when(F.col("__p").isNotNull(), to.cast(c.df.schema[k.column].dataType)).otherwise(F.col(k.column))).select(*c.df.columns)))
        self._put(name, self._written(name, replace(self.tables[name], df=rest)))

    # transactions and prepared statements
    def _begin(self):
        self.snapshots = [("", dict(self.tables))]

    def _savepoint(self, name):
        self.snapshots.append((name, dict(self.tables)))

    def _commit(self):
        self.snapshots = []

    def _rollback(self, name=None):
        at = max((i for i, (n, _) in enumerate(self.snapshots) if n == (name or "")), default=None)
        if at is None:
            raise ValueError("nothing to roll back to")
        self._restore(self.snapshots[at][1])
        self.snapshots = self.snapshots[: at + 1] if name else []

    def _release(self, name):
        self.snapshots = [s for s in self.snapshots if s[0] != name]

    def _prepare(self, name, text):
        self.prepared[name] = text

    def _execute(self, name, values):
        """The statement with its parameters: $1, $2 by place, :name by (name = value) or (name => value)."""
        given, named = [], {}
        for v in _split(values or ""):
            m = re.fullmatch(r":?([A-Za-z_]\w*)\s*(?:=>|:=|=)\s*(.*)", v, re.S)
            if m:
                named[m[1].lower()] = m[2]
            else:
                given.append(v)

        def put(m):
            if m[1]:
                if int(m[1]) > len(given):
                    raise ValueError(f"no value for ${m[1]}")
                return given[int(m[1]) - 1]
            if m[2].lower() not in named:
                raise ValueError(f"no value for :{m[2]}")
            return named[m[2].lower()]

        return self.sql(outside_quotes(self.prepared[name], r"\$(\d+)|(?<!:):([A-Za-z_]\w*)", put))

    def _deallocate(self, name):
        del self.prepared[name]

    _STATEMENTS = (
        (r"CREATE\s+TABLE\s+IF\s+NOT\s+EXISTS\s+(\w+)\s*\((.*)\)", _create_if),
        (r"CREATE\s+TABLE\s+(\w+)\s*\((.*)\)", _create),
        (r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)", _drop),
        (r"TRUNCATE\s+(?:TABLE\s+)?(\w+)(\s+RESTART\s+IDENTITY)?(?:\s+CONTINUE\s+IDENTITY)?", _truncate),
        (r"ALTER\s+TABLE\s+(\w+)\s+RENAME\s+TO\s+(\w+)", _rename_table),
        (r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)(.*)", _add),
        (r"ALTER\s+TABLE\s+(\w+)\s+DROP\s+(?:COLUMN\s+)?(\w+)", _drop_column),
        (r"ALTER\s+TABLE\s+(\w+)\s+RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", _rename),
        (r"ALTER\s+TABLE\s+(\w+)\s+MODIFY\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", _modify),
        (r"(?:CREATE|DROP)\s+(?:UNIQUE\s+)?INDEX\s+.*", lambda self: None),
        (r"INSERT\s+INTO\s+(\w+)\s*(?:\(([\w\s,]+)\))?\s*(VALUES\s*\(.*|SELECT\s.*)", _insert),
        (r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", _update),
        (r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", _delete),
        (r"(?:BEGIN|START\s+TRANSACTION)(?:\s+TRANSACTION)?(?:\s+ISOLATION\s+LEVEL\s+[\w\s]+)?", _begin),
        (r"COMMIT", _commit),
        (r"ROLLBACK(?:\s+TO\s+(?:SAVEPOINT\s+)?(\w+))?", _rollback),
        (r"SAVEPOINT\s+(\w+)", _savepoint),
        (r"RELEASE\s+(?:SAVEPOINT\s+)?(\w+)", _release),
        (r"PREPARE\s+(\w+)\s+AS\s+(.*)", _prepare),
        (r"EXECUTE\s+(\w+)\s*(?:\((.*)\))?", _execute),
        (r"DEALLOCATE\s+(?:PREPARE\s+)?(\w+)", _deallocate),
        (r"EXPLAIN\s+((?:ANALYZE\s+|VERBOSE\s+|FORMAT\s+\w+\s+|\([^()]*\)\s*)*)(SELECT.*|WITH.*)", _explain),
        (r"COMPRESS\s+TABLE\s+(\w+)(?:\s+USING\s+DNA)?", _compress),
        (r"LEARN\s+PATTERN\s+(\w+)\s+FROM\s+(\w+)(?:\s+FEATURES\s*\(([\w\s,]+)\))?", _learn),
        (r"ANALYZE\s+(?:TABLE\s+)?(\w+)", _analyze),
        (r"QUANTUM_JOIN\s+(\w+)\s*,?\s*(\w+)\s+USING\s*\(([\w\s,]+)\)", _join),
    )
