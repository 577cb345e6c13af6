"""Sessions: SQL text in, lazy DataFrames or row counts out; typed tables, constraints and transactions."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.errors import BindError, ConstraintError, TransactionError
from quern.plans.lowering import MAX_LEVELS, SPARK, Lowering, Relation, Scope, aggregates, cast, json_text, quote
from quern.plans.parser import Query, Statement, parse
from quern.plans.recursive import fixpoint
from quern.sources.catalog import ROW_ID, Catalog, columns_of, find, relation
from quern.sources.shared import new_folder


@dataclass
class Result:
    kind: str  # "rows" or "ok"
    df: DataFrame | None = None
    affected: int = 0

    @property
    def rows(self) -> list[dict]:
        """All rows on the driver, by column name; of columns with one name the last counts. For few rows."""
        return [r.asDict() for r in self.df.collect()] if self.df is not None else []

    def __iter__(self):
        """Rows as tuples of all columns, one partition at a time on the driver."""
        return map(tuple, self.df.toLocalIterator()) if self.df is not None else iter(())


class Engine:
    """A database in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, enforce: bool = True, strict: bool = False):
        self.spark, self.catalog, self.enforce, self.strict = spark, Catalog(folder), enforce, strict
        self.attached = None  # read-only tables(name) -> Relation beside the database's own
        configure(spark)

    def create_session(self) -> Session:
        return Session(self)


def configure(spark: SparkSession) -> None:
    for key, value in (("spark.sql.cteRecursionLevelLimit", MAX_LEVELS), ("spark.sql.runSQLOnFiles", "true")):
        spark.conf.set(key, str(value))


def query(spark: SparkSession, tables, text: str, params: list | None = None, strict: bool = False) -> DataFrame:
    """A SELECT of the dialect over any tables(name) -> Relation, as a lazy DataFrame."""
    configure(spark)
    (only,) = parse(text)
    found = Lowering(tables, list(params or []), union_fixpoint=fixpoint(spark), strict=strict).query(only)
    return spark.sql(found.sql).toDF(*(c for c, _ in found.columns))


@dataclass
class Prepared:
    session: Session
    statement: object
    schema_version: int

    def run(self, params: list | None = None) -> Result:
        if self.session.manifest()["schema_version"] != self.schema_version:
            raise TransactionError("the schema has changed since the statement was prepared")
        return self.session.run(self.statement, params)

    def run_many(self, params: list[list]) -> Result:
        """An INSERT ... VALUES for each list of parameters, in their order, as one statement."""
        if isinstance(self.statement, Query) or self.statement.kind != "insert" or self.statement.parts["rows"] is None:
            raise BindError("only INSERT ... VALUES takes many lists of parameters")
        if len({len(p) for p in params}) > 1:
            raise BindError("all lists need the same number of parameters")
        rows = [_renumbered(row, i * len(p)) for i, p in enumerate(params) for row in self.statement.parts["rows"]]
        statement = Statement(self.statement.kind, self.statement.name, self.statement.parts | {"rows": rows})
        return Prepared(self.session, statement, self.schema_version).run([v for p in params for v in p]) if rows else Result("ok")


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.staged: dict | None = None  # the manifest of an open transaction
        self.base = 0
        self.aborted = False

    # -- entry points
    def execute(self, text: str, params: list | None = None) -> Result:
        """Runs all statements of the text; the last one's result."""
        out = Result("ok")
        for statement in parse(text):
            out = self.run(statement, params)
        return out

    def prepare(self, text: str) -> Prepared:
        found = parse(text)
        if len(found) != 1:
            raise BindError("a prepared statement is exactly one statement")
        return Prepared(self, found[0], self.manifest()["schema_version"])

    def schema(self) -> dict:
        return copy.deepcopy({k: self.manifest()[k] for k in ("tables", "indexes")})

    def manifest(self) -> dict:
        return self.staged if self.staged is not None else self.engine.catalog.read()

    def run(self, statement, params: list | None = None) -> Result:
        kind = "query" if isinstance(statement, Query) else statement.kind
        if kind in ("begin", "commit", "rollback"):
            return getattr(self, kind)()
        if self.aborted:
            raise TransactionError("the transaction is aborted; only ROLLBACK or COMMIT can follow")
        try:
            if kind == "query":
                return Result("rows", self.select(statement, params))
            if kind == "explain":
                return Result("rows", self.explain(statement.parts["of"], params))
            return self.change(statement, params)
        except Exception:
            self.aborted = self.staged is not None
            raise

    # -- transactions
    def begin(self) -> Result:
        if self.staged is not None:
            raise TransactionError("a transaction is already open")
        self.staged = self.engine.catalog.read()
        self.base = self.staged["version"]
        return Result("ok")

    def commit(self) -> Result:
        staged, aborted = self.staged, self.aborted
        self.staged, self.aborted = None, False
        if aborted:
            raise TransactionError("the transaction was aborted and has been rolled back")
        if staged is not None:
            self.engine.catalog.commit(staged, self.base)
        return Result("ok")

    def rollback(self) -> Result:
        self.staged, self.aborted = None, False
        return Result("ok")

    def change(self, statement: Statement, params) -> Result:
        """One statement on a copy of the manifest, which replaces the manifest only if all went well."""
        manifest = copy.deepcopy(self.manifest())
        base = manifest["version"]
        affected = getattr(self, statement.kind.replace(" ", "_"))(manifest, statement, params)
        if statement.kind not in ("insert", "update", "delete"):
            manifest["schema_version"] += 1
        if self.staged is not None:
            self.staged = manifest
        else:
            self.engine.catalog.commit(manifest, base)
        return Result("ok", affected=affected)

    # -- queries
    def lowering(self, manifest: dict, params) -> Lowering:
        def table(name: str) -> Relation | None:
            found = manifest["tables"].get(name.lower())
            if found:
                return relation(found)
            return self.engine.attached(name) if self.engine.attached else None

        return Lowering(table, list(params or []), union_fixpoint=fixpoint(self.spark), strict=self.engine.strict)

    def select(self, q: Query, params=None) -> DataFrame:
        found = self.lowering(self.manifest(), params).query(q)
        return self.spark.sql(found.sql).toDF(*(c for c, _ in found.columns))

    def explain(self, statement, params) -> DataFrame:
        """The plan of a query, or of the query whose rows a statement writes or changes."""
        if isinstance(statement, Query):
            df = self.select(statement, params)
        elif statement.kind == "insert" and statement.parts["rows"] is None:
            df = self.select(statement.parts["query"], params)
        elif statement.kind in ("update", "delete"):
            manifest = self.manifest()
            df = self.hits(manifest, find(manifest, "tables", statement.name), statement, params)
        else:
            return self.spark.range(1).select(F.lit(f"{statement.kind.upper()} {statement.name}").alias("plan"))
        head = "" if isinstance(statement, Query) else f"{statement.kind.upper()} {statement.name}\n"
        return self.spark.range(1).select(F.lit(head + df._jdf.queryExecution().toString()).alias("plan"))

    # -- definitions
    def create_table(self, manifest: dict, s: Statement, params) -> int:
        if s.name.lower() in manifest["tables"]:
            if s.parts["lenient"]:
                return 0
            raise BindError(f"table {s.name!r} exists")
        columns = s.parts["columns"]
        keys = [(k, [c.lower() for c in names]) for k, names in s.parts["keys"]]
        by_name = {c["name"].lower(): c for c in columns}
        if len(by_name) != len(columns):
            raise BindError("duplicate column")
        primary = [c["name"] for c in columns if c["primary"]]
        for kind, names in keys:
            if any(n not in by_name for n in names):
                raise BindError(f"unknown column in {kind} key")
            if kind == "primary":
                primary = [by_name[n]["name"] for n in names]
        unique = [[c["name"]] for c in columns if c["unique"]] + [[by_name[n]["name"] for n in names] for k, names in keys if k == "unique"]
        for name in [*primary, *(n for u in unique for n in u)]:
            if by_name[name.lower()]["type"] in ("JSON", "BLOB"):
                raise BindError(f"{by_name[name.lower()]['type']} cannot be a key")
        auto = [c for c in columns if c["auto"]]
        if len(auto) > 1 or any(c["name"] not in primary or len(primary) != 1 or c["type"] not in ("INTEGER", "BIGINT") for c in auto):
            raise BindError("AUTOINCREMENT needs one INTEGER primary key")
        for c in columns:
            c["default"] = self.constant(c["default"], c["type"])
        manifest["tables"][s.name.lower()] = {"name": s.name, "columns": columns, "primary": primary, "unique": unique, "sequence": 0, "next_row": 0, "parts": []}
        return 0

    def constant(self, node, kind: str) -> str | None:
        if node is None:
            return None
        sql, found = Lowering(lambda _: None).expr(node, Scope([]))
        return self.coerced(sql, found, kind)

    def drop_table(self, manifest: dict, s: Statement, params) -> int:
        if s.name.lower() not in manifest["tables"] and s.parts["lenient"]:
            return 0
        find(manifest, "tables", s.name)
        del manifest["tables"][s.name.lower()]
        manifest["indexes"] = {k: v for k, v in manifest["indexes"].items() if v["table"] != s.name.lower()}
        return 0

    def add_column(self, manifest: dict, s: Statement, params) -> int:
        table, column = find(manifest, "tables", s.name), s.parts["column"]
        if column["name"].lower() in {c["name"].lower() for c in table["columns"]}:
            raise BindError(f"column {column['name']!r} exists")
        if column["primary"] or column["auto"]:
            raise BindError("a key cannot be added")
        column["default"] = self.constant(column["default"], column["type"])
        table["columns"].append(column)
        _forget(table, column["name"])  # a column dropped before may still be in a part under this name
        if column["unique"]:
            table["unique"].append([column["name"]])
        if table["parts"] and (column["unique"] or column["required"]):  # INSERT checks its own rows only
            self.check(manifest, table, self.current(table))
        return 0

    def drop_column(self, manifest: dict, s: Statement, params) -> int:
        table, name = find(manifest, "tables", s.name), s.parts["column"].lower()
        keyed = {c.lower() for c in table["primary"]} | {c.lower() for u in table["unique"] for c in u}
        if name in keyed or any(i["table"] == s.name.lower() and name in i["reads"] for i in manifest["indexes"].values()):
            raise BindError(f"column {name!r} is part of a key or index")
        table["columns"] = [c for c in table["columns"] if c["name"].lower() != name]
        _forget(table, name)
        return 0

    def create_index(self, manifest: dict, s: Statement, params) -> int:
        if s.name.lower() in manifest["indexes"]:
            if s.parts["lenient"]:
                return 0
            raise BindError(f"index {s.name!r} exists")
        if s.name.lower().startswith("__pk_"):
            raise BindError("names that begin with __pk_ are reserved")
        table = find(manifest, "tables", s.parts["table"])
        scope, lowering, exprs = Scope([("t", columns_of(table))]), Lowering(lambda _: None), []
        for node in s.parts["exprs"]:
            if aggregates(node) or _has(node, "param", "scalar", "exists", "in query"):
                raise BindError("an index takes no aggregates, subqueries or parameters")
            sql, kind = lowering.expr(node, scope)
            if kind == "BLOB" or kind == "JSON" and len(node[1]) == 1:
                raise BindError(f"{kind} cannot be indexed")
            exprs.append({"sql": sql, "json": kind == "JSON"})
        reads = sorted({str(p).lower() for node in s.parts["exprs"] for p in _columns(node)})
        index = {"name": s.name, "table": s.parts["table"].lower(), "exprs": exprs, "unique": s.parts["unique"], "reads": reads}
        if table["parts"]:
            self.check_index(self.spark.sql(f"SELECT * FROM {relation(table).sql} AS t"), index)
        manifest["indexes"][s.name.lower()] = index
        return 0

    def drop_index(self, manifest: dict, s: Statement, params) -> int:
        if s.name.lower() in manifest["indexes"]:
            del manifest["indexes"][s.name.lower()]
        elif not s.parts["lenient"]:
            raise BindError(f"unknown index {s.name!r}")
        return 0

    # -- data
    def current(self, table: dict) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {relation(table, with_row_id=True).sql} AS t")

    def coerced(self, sql: str, kind: str, target: str) -> str:
        """A value on its way into a column: text becomes JSON, else Spark's checked cast to the declared type."""
        if target == "JSON":
            return json_text(sql) if kind in ("TEXT", "ANY") else cast(sql, kind, "TEXT")
        return f"CAST({sql} AS {SPARK[target]})"

    def insert(self, manifest: dict, s: Statement, params) -> int:
        table = find(manifest, "tables", s.name)
        lowering = self.lowering(manifest, params)
        by_name = {c["name"].lower(): c for c in table["columns"]}
        chosen = [c.lower() for c in s.parts["columns"] or [c["name"] for c in table["columns"]]]
        if len(set(chosen)) != len(chosen):
            raise BindError("duplicate column in INSERT")
        if unknown := [c for c in chosen if c not in by_name]:
            raise BindError(f"unknown column {unknown[0]!r}")
        if s.parts["rows"] is not None:
            given = self.values(s.parts["rows"], [by_name[c] for c in chosen], lowering)
        else:
            source = lowering.query(s.parts["query"])
            if len(source.columns) != len(chosen):
                raise BindError(f"{len(source.columns)} columns for {len(chosen)}")
            names = [f"__s{i}" for i in range(len(chosen))]
            found = self.spark.sql(source.sql).toDF(*names)
            cols = [F.expr(self.coerced(n, k, by_name[c]["type"])).alias(by_name[c]["name"]) for n, (_, k), c in zip(names, source.columns, chosen)]
            given = found.select(F.monotonically_increasing_id().alias("__ord"), *cols)
        missing = [c for c in table["columns"] if c["name"].lower() not in chosen]
        given = given.select("*", *(F.expr(f"CAST({c['default'] or 'NULL'} AS {SPARK[c['type']]})").alias(c["name"]) for c in missing))
        # written once: the order column must not change between the passes below
        path = new_folder(self.spark)
        given.write.parquet(path)
        given = self.spark.read.parquet(path)
        auto = next((c["name"] for c in table["columns"] if c["auto"]), None)
        if auto:
            given = self.numbered(given, auto, table)
        given = given.select("__ord", *(quote(c["name"]) for c in table["columns"]))
        if s.parts["conflict"]:
            return self.upsert(manifest, table, given, s.parts["conflict"], params)
        return self.append(manifest, table, self.with_row_ids(table, given))

    def values(self, rows: list, columns: list[dict], lowering: Lowering) -> DataFrame:
        """VALUES as (__ord, columns). Rows of constants travel as data, so their number does not grow the plan."""
        constants: dict[tuple, list] = {}
        computed = []
        for order, row in enumerate(rows):
            if len(row) != len(columns):
                raise BindError(f"{len(row)} values for {len(columns)} columns")
            known = [_known(v, lowering.params) for v in row]
            if None in known:
                items = (f"{self.coerced(*lowering.expr(v, Scope([])), c['type'])} AS {quote(c['name'])}" for v, c in zip(row, columns))
                computed.append(f"SELECT {order}L AS __ord, {', '.join(items)}")
            else:
                constants.setdefault(tuple(k for _, k in known), []).append((order, *(v for v, _ in known)))
        parts = [self.spark.sql(" UNION ALL ".join(computed[i : i + 50])).coalesce(1) for i in range(0, len(computed), 50)]
        for kinds, data in constants.items():
            names = [f"__v{i}" for i in range(len(kinds))]
            schema = ", ".join(["__ord BIGINT", *(f"{n} {SPARK[k] if k != 'NULL' else 'STRING'}" for n, k in zip(names, kinds))])
            items = (f"{self.coerced(n, k, c['type'])} AS {quote(c['name'])}" for n, k, c in zip(names, kinds, columns))
            parts.append(self.spark.createDataFrame(data, schema).selectExpr("__ord", *items))
        return reduce(DataFrame.union, parts)

    def numbered(self, given: DataFrame, column: str, table: dict) -> DataFrame:
        """Fills null ids in input order: one more than the largest id so far, explicit ids included.

        Input is cut in partitions of order; each one's rows and largest id are few numbers, from which the
        driver works out where each partition's numbering starts.
        """
        data = given.repartitionByRange("__ord").sortWithinPartitions("__ord").select("*", F.spark_partition_id().alias("__part"))
        path = new_folder(self.spark)
        data.write.parquet(path)
        data = self.spark.read.parquet(path)
        id_ = F.col(quote(column))
        up = Window.partitionBy("__part").orderBy("__ord")
        # within a partition: nulls since an explicit id, on top of the running maximum of (explicit id - nulls before it)
        nulls = F.sum(F.when(id_.isNull(), 1).otherwise(0)).over(up)
        lead = F.max(F.when(id_.isNotNull(), id_ - nulls)).over(up)
        data = data.withColumns({"__nulls": nulls, "__lead": lead})
        parts = data.groupBy("__part").agg(F.max("__nulls"), F.max("__lead")).orderBy("__part").collect()
        start, starts = table["sequence"], {}
        for part, n, top in parts:
            starts[part] = start
            start = max(start + n, (top + n) if top is not None else start + n)
        table["sequence"] = start
        if not starts:
            return data.drop("__part", "__nulls", "__lead")
        first = F.create_map(*(F.lit(x).cast("long") for k, v in starts.items() for x in (k, v)))[F.col("__part").cast("long")]
        filled = F.coalesce(id_, F.greatest(first, F.coalesce("__lead", first)) + F.col("__nulls"))
        return data.withColumn(column, filled).drop("__part", "__nulls", "__lead")

    def with_row_ids(self, table: dict, given: DataFrame) -> DataFrame:
        return given.select((F.lit(table["next_row"]) + F.col("__ord")).alias(ROW_ID), *(quote(c["name"]) for c in table["columns"]))

    def append(self, manifest: dict, table: dict, new: DataFrame, changed: set[str] | None = None) -> int:
        """Checks new rows against the rules and the keys of the stored ones, and writes them as a part.

        The part takes in the latest parts of up to twice its rows, and parts of which most rows are gone.
        """
        n, last = new.agg(F.count("*"), F.max(ROW_ID)).first()
        if n:
            self.check(manifest, table, new, self.current(table) if table["parts"] else None, changed)
        merged = [p for p in table["parts"] if p.get("dead", 0) > p["rows"]]
        rest, total = [p for p in table["parts"] if p not in merged], n + sum(p["rows"] for p in merged)
        while n and rest and rest[-1]["rows"] <= 2 * total:
            merged.append(rest.pop())
            total += merged[-1]["rows"]
        if not total:
            return 0
        if merged:
            new = new.unionByName(self.current(table | {"parts": merged}))
            if table["primary"]:  # these rows are written again anyway: files of disjoint keys
                new = new.repartitionByRange(*(quote(k) for k in table["primary"]))
        table["parts"] = rest
        self.add_part(table, new, total)
        table["next_row"] = max(table["next_row"], (last or 0) + 1)
        return n

    def add_part(self, table: dict, data: DataFrame, rows: int) -> None:
        """Files are sorted by the primary key, so that a lookup by key reads few pages of each."""
        path = self.engine.catalog.new_part(table["name"])
        if table["primary"]:
            data = data.sortWithinPartitions(*(quote(k) for k in table["primary"]))
        data.write.parquet(path)
        table["parts"].append({"path": path, "columns": [c["name"] for c in table["columns"]], "rows": rows})

    def retire(self, table: dict, rows: DataFrame) -> int:
        """Marks stored rows as gone: their row ids become a table that scans of the parts that hold them leave out."""
        path = self.engine.catalog.new_part(table["name"])
        rows.select(ROW_ID).write.parquet(path)
        gone, total = self.spark.read.parquet(path), 0
        each = [self.current(table | {"parts": [p]}).select(ROW_ID, F.lit(i).alias("part")) for i, p in enumerate(table["parts"])]
        counts = dict(map(tuple, reduce(DataFrame.union, each).join(gone, ROW_ID, "left_semi").groupBy("part").count().collect())) if each else {}
        for i, n in counts.items():
            part = table["parts"][i]
            table["parts"][i] = part | {"rows": part["rows"] - n, "dead": part.get("dead", 0) + n, "gone": [*part.get("gone", []), path]}
            total += n
        table["parts"] = [p for p in table["parts"] if p["rows"]]
        return total

    def upsert(self, manifest: dict, table: dict, given: DataFrame, conflict: dict, params) -> int:
        """ON CONFLICT, as if row by row: the n-th row of each key is handled in the n-th round.

        DO NOTHING adds a part. DO UPDATE works on the stored rows whose keys are given, and leaves the others where they are.
        """
        keys = self.conflict_keys(manifest, table["name"].lower(), table, conflict["target"])
        names = [c["name"] for c in table["columns"]]
        self.check_required(table, given, [c for c in table["columns"] if c["required"]])  # conflict or not
        complete = F.lit(True)
        for k in keys:
            complete = complete & F.col(quote(k)).isNotNull()
        rank = F.when(complete, F.row_number().over(Window.partitionBy(*(quote(k) for k in keys), complete).orderBy("__ord"))).otherwise(F.lit(1))
        path = new_folder(self.spark)
        given.withColumn("__rank", rank).write.parquet(path)
        given = self.spark.read.parquet(path)
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"t.{quote(k)}") == F.col(f"excluded.{quote(k)}"))
        stored = self.current(table).alias("t")
        if conflict["set"] is None:
            first = self.with_row_ids(table, given.filter("__rank = 1")).alias("excluded")
            return self.append(manifest, table, first.join(stored, same, "left_anti"))
        rounds, affected = given.agg(F.max("__rank")).first()[0] or 0, 0
        touched = given.filter("__rank = 1").select(*(quote(k) for k in keys)).dropna().alias("excluded")
        state = old_rows = self.rewritten(stored.join(touched, same, "left_semi"))
        for r in range(1, rounds + 1):
            new = self.with_row_ids(table, given.filter(F.col("__rank") == r))
            old, inc = state.alias("t"), new.alias("excluded")
            fresh = inc.join(old, same, "left_anti")
            lowering = self.lowering(manifest, params)
            inner = Scope([("t", columns_of(table))], Scope([("excluded", columns_of(table))]))
            sets = {}
            for c, node in conflict["set"]:
                column = next((x for x in table["columns"] if x["name"].lower() == c.lower()), None)
                if column is None:
                    raise BindError(f"unknown column {c!r}")
                sets[column["name"]] = self.coerced(*lowering.expr(_named(node, table["name"]), inner), column["type"])
            where = lowering.condition(_named(conflict["where"], table["name"]), inner) if conflict["where"] else "TRUE"
            joined = old.join(inc, same, "left")
            hit = f"(excluded.{ROW_ID} IS NOT NULL AND coalesce({where}, FALSE))"
            affected += joined.filter(hit).count() + fresh.count()
            kept = joined.selectExpr(f"t.{ROW_ID} AS {ROW_ID}", *(f"CASE WHEN {hit} THEN {sets[n]} ELSE t.{quote(n)} END AS {quote(n)}" if n in sets else f"t.{quote(n)} AS {quote(n)}" for n in names))
            state = self.rewritten(kept.unionByName(fresh.select(ROW_ID, *(quote(n) for n in names))))
        self.retire(table, old_rows)
        self.append(manifest, table, state)
        return affected

    def rewritten(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def conflict_keys(self, manifest: dict, name: str, table: dict, target) -> list[str]:
        plain = [i for i in manifest["indexes"].values() if i["table"] == name and i["unique"] and len(i["reads"]) == len(i["exprs"]) and all(e["sql"].count("`") == 4 for e in i["exprs"])]
        options = [table["primary"]] * bool(table["primary"]) + table["unique"] + [i["reads"] for i in plain]
        if target is None:
            if not options:
                raise BindError("ON CONFLICT needs a key")
            return options[0]
        for option in options:
            if sorted(c.lower() for c in option) == sorted(c.lower() for c in target):
                return list(option)
        raise BindError("ON CONFLICT names no key")

    def hits(self, manifest: dict, table: dict, s: Statement, params, sets: list | None = None) -> DataFrame:
        """The rows an UPDATE or DELETE is about, with their new values. Values of other rows are not worked out."""
        lowering, scope = self.lowering(manifest, params), Scope([(s.name, columns_of(table))])
        new = {}
        for c, node in s.parts.get("set") or []:
            column = next((x for x in table["columns"] if x["name"].lower() == c.lower()), None)
            if column is None:
                raise BindError(f"unknown column {c!r}")
            new[column["name"]] = self.coerced(*lowering.expr(node, scope), column["type"])
        if sets is not None:
            sets += new
        items = [f"{new[c['name']]} AS {quote(c['name'])}" if c["name"] in new else quote(c["name"]) for c in table["columns"]]
        where = f" WHERE {lowering.filtered(s.parts['where'], scope)}" if s.parts["where"] else ""
        return self.spark.sql(f"SELECT {', '.join([ROW_ID, *items])} FROM {relation(table, with_row_id=True).sql} AS {quote(s.name)}{where}")

    def update(self, manifest: dict, s: Statement, params) -> int:
        table, changed = find(manifest, "tables", s.name), []
        new = self.rewritten(self.hits(manifest, table, s, params, changed))
        affected = self.retire(table, new)
        self.append(manifest, table, new, {c.lower() for c in changed})
        return affected

    def delete(self, manifest: dict, s: Statement, params) -> int:
        table = find(manifest, "tables", s.name)
        if not s.parts["where"]:
            affected, table["parts"] = sum(p["rows"] for p in table["parts"]), []
            return affected
        gone = self.hits(manifest, table, s, params)
        affected = self.retire(table, gone)
        self.append(manifest, table, gone.limit(0))
        return affected

    def check(self, manifest: dict, table: dict, data: DataFrame, stored: DataFrame | None = None, changed: set[str] | None = None) -> None:
        """All rules on data, or those that read a changed column; keys must not be among the stored rows either."""
        concerns = lambda names: changed is None or not changed.isdisjoint(n.lower() for n in names)
        if self.engine.enforce:
            self.check_required(table, data, [c for c in table["columns"] if (c["required"] or c["primary"]) and concerns([c["name"]])])
        for keys in [table["primary"], *(table["unique"] if self.engine.enforce else [])]:
            if keys and concerns(keys):
                self.check_unique(data, [quote(k) for k in keys], f"{table['name']}.{', '.join(keys)}", stored)
        for index in manifest["indexes"].values():
            if index["table"] == table["name"].lower() and concerns(index["reads"]):
                self.check_index(data, index, stored)

    def check_required(self, table: dict, data: DataFrame, columns: list[dict]) -> None:
        """One pass for all columns."""
        if not columns or not self.engine.enforce:
            return
        missing = data.agg(*(F.max(F.col(quote(c["name"])).isNull()) for c in columns)).first()
        for c, found in zip(columns, missing):
            if found:
                raise ConstraintError(f"NOT NULL constraint failed: {table['name']}.{c['name']}")

    def check_unique(self, data: DataFrame, exprs: list[str], what: str, stored: DataFrame | None = None) -> None:
        keyed = lambda df: df.alias("t").selectExpr(*(f"{e} AS k{i}" for i, e in enumerate(exprs))).dropna()
        new = keyed(data)
        repeated = not new.groupBy(*new.columns).count().filter("count > 1").isEmpty()
        if repeated or stored is not None and not keyed(stored).join(new, new.columns, "left_semi").isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {what}")

    def check_index(self, data: DataFrame, index: dict, stored: DataFrame | None = None) -> None:
        for e in index["exprs"]:
            if e["json"] and not data.alias("t").selectExpr(f"{e['sql']} AS k").filter("k LIKE '{%' OR k LIKE '[%'").isEmpty():
                raise ConstraintError(f"index {index['name']}: a key must be a scalar")
        if index["unique"]:
            self.check_unique(data, [e["sql"] for e in index["exprs"]], f"index {index['name']}", stored)


def _forget(table: dict, column: str) -> None:
    """From now on the table's parts have no column of this name."""
    for part in table["parts"]:
        part["columns"] = [c for c in part["columns"] if c.lower() != column.lower()]


def _has(node, *kinds: str) -> bool:
    return isinstance(node, (tuple, list)) and (bool(node) and node[0] in kinds or any(_has(x, *kinds) for x in node))


def _known(node, params: list) -> tuple[object, str] | None:
    """(value, type) of a constant, or None for all other expressions."""
    kind = node[0]
    if kind == "param":
        v = params[int(node[1]) - 1] if 0 < int(node[1]) <= len(params) else ()
        of = {type(None): "NULL", bool: "BOOLEAN", int: "INTEGER", float: "REAL", bytes: "BLOB", str: "TEXT"}.get(type(v))
        return (v, of) if of and (of != "INTEGER" or -(2**63) <= v < 2**63) else None
    if kind == "minus":
        found = _known(node[1], params)
        return (-found[0], found[1]) if found and found[1] in ("INTEGER", "REAL") else None
    if kind == "int":
        return (int(node[1]), "INTEGER") if int(node[1]) < 2**63 else None
    if kind == "constant":
        return (None, "NULL") if node[1] == "null" else (node[1] == "true", "BOOLEAN")
    known = {"float": (float, "REAL"), "text": (str, "TEXT"), "blob": (bytes.fromhex, "BLOB")}.get(kind)
    return (known[0](node[1]), known[1]) if known else None


def _renumbered(node, shift: int):
    if isinstance(node, tuple) and node and node[0] == "param":
        return ("param", str(int(node[1]) + shift))
    if isinstance(node, (tuple, list)):
        return type(node)(_renumbered(x, shift) for x in node)
    return node


def _columns(node):
    if isinstance(node, (tuple, list)):
        if node and node[0] == "column":
            yield node[1][0]
        else:
            for x in node:
                yield from _columns(x)


def _named(node, table: str):
    """References to the target's own name read the stored row, called t in the joins of ON CONFLICT."""
    if isinstance(node, tuple) and node and node[0] == "column" and len(node[1]) > 1 and str(node[1][0]).lower() == table.lower():
        return ("column", ["t", *node[1][1:]])
    if isinstance(node, (tuple, list)):
        return type(node)(_named(x, table) for x in node)
    return node
