"""connect() and Session.execute(): the statement interface."""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import statements as S
from .cache import ResultCache
from .catalog import Catalog
from .errors import EngineError, ParseError
from .types import describe

#: Called for each row with the values as text (None for NULL) and the column names; a true result ends the delivery.
Callback = Callable[[list[str | None], list[str]], object]


@dataclass
class Result:
    """Column names and rows. Rows of a SELECT are fetched when they are asked for, a partition at a time."""

    columns: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    kept: list[tuple] | None = None
    elapsed: float = 0.0
    is_query: bool = False

    def __iter__(self) -> Iterator[tuple]:
        if self.kept is not None:
            return iter(self.kept)
        return map(tuple, self.df.toLocalIterator()) if self.df is not None else iter(())

    @property
    def rows(self) -> list[tuple]:
        """All rows at once, for results known to be small."""
        return list(self)

    def __len__(self) -> int:
        return len(self.kept) if self.kept is not None else self.df.count() if self.df is not None else 0


class Session:
    """Statements over the tables of one root folder.

    `strict` allows a single condition in WHERE. Results of plain SELECTs are kept by the tables' versions, unless a table
    has rows that expire.
    """

    def __init__(self, spark: SparkSession, root: str, strict: bool = False, cache_entries: int = 1024):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")  # no escapes in literals
        self.catalog = Catalog(self.spark, root)
        self.strict, self.cache = strict, ResultCache(cache_entries)
        self.last = Result()

    # what the last statement returned, for callers of the callback interface
    @property
    def last_was_query(self) -> bool:
        return self.last.is_query

    @property
    def last_columns(self) -> list[str]:
        return self.last.columns

    def execute(self, sql: str, callback: Callback | None = None) -> Result:
        """Runs one statement; failures raise EngineError."""
        began = time.perf_counter()
        try:
            result = self._run(S.parse(sql, self.strict))
            if callback is not None:
                for row in result:
                    if callback([_text(v) for v in row], result.columns):
                        break
        except EngineError:
            raise
        except ParseException as e:
            raise ParseError(_first_line(e)) from e
        except AnalysisException as e:
            raise EngineError(_analysis(e, sql)) from e
        except PySparkException as e:
            raise EngineError(_first_line(e)) from e
        result.elapsed = time.perf_counter() - began
        self.last = result
        return result

    def table(self, name: str) -> DataFrame:
        """The live rows of a table, for the DataFrame API."""
        return self.catalog.table(name)

    def close(self) -> None:
        self.cache.clear()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _run(self, s: object) -> Result:
        c = self.catalog
        match s:
            case S.Select():
                return self._select(s.sql)
            case S.CreateTable():
                c.create(s.schema, s.if_not_exists)
            case S.DropTable():
                c.drop(s.table, s.if_exists)
            case S.Insert():
                c.insert(s.table, s.columns, s.rows, s.by_column)
            case S.Update():
                return Result(["rows_updated"], kept=[(c.update(s.table, [(name, S.plain(text)) for name, text in s.assignments], _plain(s.where)),)])
            case S.Delete():
                c.delete(s.table, _plain(s.where))
            case S.Truncate():
                c.truncate(s.table)
            case S.Show(what="TABLES"):
                return Result(["Tables"], kept=[(t,) for t in c.tables()], is_query=True)
            case S.Show():
                return Result(["Database"], kept=[("default",)], is_query=True)
            case S.Describe():
                return Result(["Field", "Type", "Key", "Null"], kept=describe(c.version(s.table).schema.columns), is_query=True)
            case S.Alter():
                c.version(s.table)
                raise EngineError(ALTER[s.action])
        return Result()

    def _select(self, sql: str) -> Result:
        written, sql = sql, S.plain(sql)
        words = {t.name for t in S.tokenize(sql) if t.kind == "word"}
        versions = self.catalog.refresh(sorted(words & (self.catalog.store.names() | {*self.catalog.viewed})))
        key = None if any(map(self.catalog.has_ttl, versions)) or _changes(words) else (sql, tuple(versions.items()))
        if key is not None and (kept := self.cache.get(key)) is not None:
            return Result(kept.columns, kept.df, kept.kept, is_query=True)
        df = _named(self.spark.sql(sql), written)
        result = Result(df.columns, df, is_query=True)
        if key is not None:
            result = _Keeping(result.columns, df, is_query=True, cache=self.cache, key=key)
        return result


@dataclass
class _Keeping(Result):
    """A result that goes to the cache once it has been read to its end, if it is small."""

    cache: ResultCache | None = None
    key: object = None

    def __iter__(self) -> Iterator[tuple]:
        if self.kept is not None:
            yield from self.kept
            return
        rows = map(tuple, self.df.toLocalIterator())
        head = list(islice(rows, self.cache.max_rows + 1))
        yield from head
        if len(head) <= self.cache.max_rows:
            self.kept = head
            self.cache.put(self.key, self)
        yield from rows


#: Schemas are fixed once a table is made.
ALTER = {
    "DROP": "ALTER TABLE DROP COLUMN not supported (schema is immutable after creation)",
    "ADD": "ALTER TABLE ADD COLUMN not yet supported",
    "MODIFY": "ALTER TABLE MODIFY COLUMN not yet supported",
}
#: A statement with one of these words may give other rows each time.
CHANGING = {"RAND", "RANDOM", "RANDN", "UUID", "NOW", "CURRENT_TIMESTAMP", "CURRENT_DATE", "UNIX_TIMESTAMP", "LOCALTIMESTAMP", "SHUFFLE", "TABLESAMPLE", "CURDATE"}


def _changes(words: set[str]) -> bool:
    return bool(words & CHANGING)


def _plain(where: str | None) -> str | None:
    return None if where is None else S.plain(where)


def _named(df: DataFrame, sql: str) -> DataFrame:
    """Output names: calls as they are written, in capitals; TABLE.COLUMN for the star of a join."""
    names = S.output_names(sql)
    if names is not None and any(names) and len(names) == len(df.columns):
        return df.toDF(*[n or c for n, c in zip(names, df.columns, strict=True)])
    tables = S.joined_tables(sql)
    if tables is not None:
        spark = df.sparkSession
        origins = re.search(r"FROM\s+(\w+).*?JOIN\s+(\w+)", sql, re.I | re.S)
        n = len(spark.table(origins[1]).columns)
        return df.toDF(*[f"{tables[i >= n]}.{c}" for i, c in enumerate(df.columns)])
    return df


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    text = str(value)
    return text.rstrip("0").rstrip(".") if type(value).__name__ == "Decimal" and "." in text and "E" not in text else text


def _first_line(e: Exception) -> str:
    return str(e).strip().split("\n")[0]


def _analysis(e: AnalysisException, sql: str = "") -> str:
    kind, given = e.getCondition() or "", e.getMessageParameters() or {}
    plain = lambda name: re.sub(r'[`"]', "", name).split(".")[-1].upper()
    if kind.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return f"no such table: {given.get('relationName', '').replace('`', '').upper()}"
    if kind.startswith("UNRESOLVED_COLUMN"):
        name = given.get("objectName", "").replace("`", "").upper()
        if plain(name) in S.clause_words(sql, "ON"):
            return "join column not found"
        if plain(name) in S.clause_words(sql, "GROUP"):
            return f"GROUP BY: unknown column: {plain(name)}"
        return f"unknown column: {name}"
    if kind.startswith("MISSING_AGGREGATION"):
        return f"SELECT column not in GROUP BY: {plain(given.get('expression', ''))}"
    return _first_line(e)


def connect(root: str | None = None, spark: SparkSession | None = None, strict: bool = False) -> Session:
    """A session over the tables under `root`, which must be a shared folder on a cluster; without one, a local session gets a temporary folder."""
    spark = spark or SparkSession.builder.getOrCreate()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise EngineError("a cluster needs a root folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tables-')}"
    return Session(spark, root, strict)
