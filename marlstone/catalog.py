"""The tables of a session: schemas, live views, and statements that change them."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal, localcontext
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .operators import dml
from .operators.ttl import alive
from .sources.storage import Segment, Store, Version
from .types import EXPIRES, Schema

FILE = "_file"


class Catalog:
    """All statements on a table run under its lock and end in one new version, or in an error and no change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root.rstrip("/"))
        self.viewed: dict[str, str] = {}

    def version(self, table: str) -> Version:
        found = self.store.current(table.upper())
        if found is None:
            raise EngineError(f"no such table: {table.upper()}")
        return found

    def tables(self) -> list[str]:
        return self.store.tables()

    def create(self, schema: Schema, if_not_exists: bool = False) -> None:
        with self.store.lock(schema.name):
            if self.store.current(schema.name) is None:
                self.store.create(schema)
            elif not if_not_exists:
                raise EngineError(f"table already exists: {schema.name}")

    def drop(self, table: str, if_exists: bool = False) -> None:
        with self.store.lock(table):
            if self.store.current(table) is None:
                if if_exists:
                    return
                raise EngineError(f"no such table: {table}")
            self.store.drop(table)
            self.viewed.pop(table, None)
            self.spark.catalog.dropTempView(table)

    def live(self, version: Version, now: int | None = None, expiry: bool = False) -> DataFrame:
        """The rows that have not expired; the expiry is tested only where a segment has any."""
        df = self.store.read(version)
        if any(s.expires for s in version.segments):
            df = df.where(alive(now=now))
        return df if expiry else df.drop(EXPIRES)

    def table(self, name: str, now: int | None = None) -> DataFrame:
        return self.live(self.version(name), now)

    def refresh(self, names: Sequence[str]) -> dict[str, str]:
        """Brings the views of the named tables up to date; returns the names of the versions that they show (empty where there is no such table)."""
        out = {}
        for name in names:
            version = self.store.current(name)
            if version is None:
                self.viewed.pop(name, None)
                self.spark.catalog.dropTempView(name)
            elif self.viewed.get(name) != version.name:
                self.live(version).createOrReplaceTempView(name)
                self.viewed[name] = version.name
            out[name] = version.name if version else ""
        return out

    def has_ttl(self, table: str) -> bool:
        version = self.store.current(table)
        return version is not None and any(s.expires for s in version.segments)

    # -- writes

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Appends a DataFrame that has the table's columns, and perhaps the expiry; the way to load in bulk.

        `batch` names a stream and its batch; one that was taken before is left out, so a batch that is run again is not doubled.
        """
        with self.store.lock(table.upper()):
            version = self.version(table)
            if batch and dict(version.batches).get(batch[0], -1) >= batch[1]:
                return
            given = {c.upper(): c for c in rows.columns}
            unknown = [c for c in given if c not in version.schema.names and c != EXPIRES.upper()]
            if unknown:
                raise EngineError(f"unknown column: {unknown[0]}")
            expiry = given.get(EXPIRES.upper())
            typed = rows.select(
                *[(F.col(given[c.name]) if c.name in given else F.lit(None)).cast(c.spark_type).alias(c.name) for c in version.schema.columns],
                F.coalesce(F.col(expiry).cast("long"), F.lit(0)).alias(EXPIRES) if expiry else F.lit(0).cast("long").alias(EXPIRES),
            )
            self._append(version, self.store.write(version, typed), batch)

    def insert(self, table: str, columns: list[str] | None, rows: list[list[str | None]] | None = None, by_column: list[list[str | None]] | None = None) -> None:
        """INSERT ... VALUES, by rows or, if all rows are equally long, by columns. One value more than there are columns is the row's expiry; every row is checked.

        The rows are a statement's own, so they are typed and written where the statement is; only keys may need a look at the table.
        """
        with self.store.lock(table):
            version = self.version(table)
            schema = version.schema
            for c in columns or ():
                if schema.column(c) is None:
                    raise EngineError(f"unknown column: {c}")
            names = columns or schema.names
            if by_column is None:
                for row in rows:
                    if len(row) != len(names) and (columns is not None or len(row) != len(names) + 1):
                        raise EngineError(f"column count mismatch: expected {len(names)} got {len(row)}")
                by_column = [list(c) for c in zip(*[row if len(row) > len(names) else [*row, "0"] for row in rows], strict=True)]
            elif len(by_column) != len(names) and (columns is not None or len(by_column) != len(names) + 1):
                raise EngineError(f"column count mismatch: expected {len(names)} got {len(by_column)}")
            n = len(by_column[0])
            given = dict(zip(names, by_column))
            arrays, wrong = [], []
            for c in schema.columns:
                values, bad = self._typed(given.get(c.name, [None] * n), c.type)
                if bad is not None:
                    wrong.append((bad, len(arrays), f"invalid {c.type} value for column {c.name}: {given[c.name][bad]}"))
                arrays.append(values)
            if wrong:
                raise EngineError(min(wrong)[2])
            for c, values in zip(schema.columns, arrays, strict=True):
                if c.not_null and values.null_count:
                    raise EngineError(f"column {c.name} must not be null")
            expires = [_expiry(t) for t in by_column[-1]] if len(by_column) > len(names) and {*by_column[-1]} != {"0"} else [0] * n
            made = pa.table([*arrays, pa.array(expires, pa.int64())], [*schema.names, EXPIRES])
            key = schema.key
            if key is not None:
                own = made[key.name]
                if len(pc.unique(own)) < n:
                    seen = set()
                    again = next(k for k in own.to_pylist() if k in seen or seen.add(k))
                    raise EngineError(f"duplicate primary key: {_plain(again)}")
                self._refuse_known(version, own)
                made = made.sort_by(key.name)
            segment = Segment(self.store.write_table(version, made), min((e for e in expires if e), default=0), None, _range(made[key.name]) if key is not None else None)
            self.store.commit(replace(version, segments=(*version.segments, segment)))

    def _typed(self, texts: list[str | None], kind: str) -> tuple[pa.Array, int | None]:
        """Texts as an Arrow array of a declared type, and where the first one stands that isn't of the type."""
        if kind in ("VARCHAR", "TEXT"):
            return pa.array(texts, pa.string()), None
        if kind == "DATETIME":  # Spark knows the forms of a time
            raw = self.spark.createDataFrame(list(enumerate(texts)), "i long, t string")
            values = raw.select("i", _moment(F.col("t")).cast("timestamp_ntz").alias("v")).toArrow().sort_by("i")["v"].combine_chunks()
            values = values.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            bad = next((i for i, (t, ok) in enumerate(zip(texts, values.is_valid().to_pylist(), strict=True)) if t is not None and not ok), None)
            return values, bad
        form, given = (INTEGER if kind == "INT" else DECIMAL), [t for t in texts if t is not None]
        if given and not re.fullmatch(f"(?:(?:{form.pattern})\n)*", "\n".join([*given, ""])):
            bad = next((i for i, t in enumerate(texts) if t is not None and not form.fullmatch(t)), None)
            return pa.nulls(len(texts)), bad
        if kind == "INT":
            values = [None if t is None else int(t) for t in texts]
            bad = next((i for i, v in enumerate(values) if v is not None and not -(1 << 63) <= v < 1 << 63), None)
            return (pa.array(values, pa.int64()) if bad is None else pa.nulls(len(texts))), bad
        if max(map(len, given), default=0) <= 10:  # no digit too many on either side
            return pa.array(texts, pa.string()).cast(pa.decimal128(28, 10)), None
        with localcontext(prec=max(200, *map(len, given))):
            values = [None if t is None else Decimal(t).quantize(TENTH, ROUND_HALF_UP) for t in texts]
        bad = next((i for i, v in enumerate(values) if v is not None and abs(v) >= LARGEST), None)
        return (pa.array(values, pa.decimal128(28, 10)) if bad is None else pa.nulls(len(texts))), bad

    def _refuse_known(self, version: Version, keys: pa.ChunkedArray) -> None:
        """Raises if a live row has one of the keys. Segments whose keys lie elsewhere aren't read; up to KEYS keys are looked up by pushed-down
        filters, more are joined, the table being the side that is read through."""
        lo, hi = _range(keys)
        some = tuple(s for s in version.segments if lo is not None and s.may_hold(lo, hi))
        if not some:
            return
        name, values = version.schema.key.name, [k for k in keys.to_pylist() if k is not None]
        rows = self.live(replace(version, segments=some)).select(name)
        if len(values) <= KEYS:
            again = rows.where(F.col(name).isin(values)).first()
        else:
            new = self.spark.createDataFrame([(k,) for k in values], T.StructType([T.StructField(name, version.schema.key.spark_type)]))
            again = rows.join(new, name).first()
        if again:
            raise EngineError(f"duplicate primary key: {_plain(again[0])}")

    def _append(self, version: Version, path: str, batch: tuple[str, int] | None = None) -> None:
        """Checks what was written, so that a source is read once; only then the rows count."""
        segment = self._checked(version, path, version.segments)
        batches = tuple({**dict(version.batches), batch[0]: batch[1]}.items()) if batch else version.batches
        self.store.commit(replace(version, segments=(*version.segments, *([segment] if segment else ())), batches=batches))

    def _checked(self, version: Version, path: str, beside: tuple[Segment, ...] | None) -> Segment | None:
        """The segment that was written to a folder, or None if it has no rows. One pass finds nulls, expiries and the range of keys.

        The primary key is checked within it and against live rows of `beside`, unless that is None.
        """
        schema, key = version.schema, version.schema.key
        rows = self.store.read(version, (Segment(path),))
        needed = [c.name for c in schema.columns if c.not_null]
        found = rows.agg(
            F.count("*").alias("n"), F.min(F.when(F.col(EXPIRES) != 0, F.col(EXPIRES))).alias("expires"),
            *([F.min(key.name).alias("lo"), F.max(key.name).alias("hi")] if key is not None else []), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in needed],
        ).first()
        if not found.n:
            return None
        for c in needed:
            if found[f"null {c}"]:
                raise EngineError(f"column {c} must not be null")
        span = None if key is None else _kept_range(found.lo, found.hi)
        if key is not None and beside is not None:
            others = tuple(s for s in beside if span is None or s.may_hold(*span))
            again = dml.duplicate_keys(self.live(replace(version, segments=others)), rows, key.name).first() if others else dml.repeated_keys(rows, key.name).first()
            if again:
                raise EngineError(f"duplicate primary key: {_plain(again[0])}")
        return Segment(path, found.expires or 0, None, span)

    def _touched(self, version: Version, condition: Expression | None) -> tuple[dict[Segment, set[str]], int]:
        """The files with live rows that meet the condition, by segment, and how many rows; other files stay as they are."""
        if not version.segments:
            return {}, 0
        df = self.store.read(version).select("*", F.col("_metadata.file_path").alias(FILE)).where(alive())
        counts = (df if condition is None else df.where(condition)).groupBy(FILE).agg(F.count("*").alias("n")).collect()  # a row for each file that is touched
        of = {s.name: s for s in version.segments}
        hit: dict[Segment, set[str]] = {}
        for r in counts:
            *_, folder, file = unquote(r[FILE]).split("/")
            hit.setdefault(of[folder], set()).add(file)
        return hit, sum(r.n for r in counts)

    def _split(self, version: Version, hit: dict[Segment, set[str]]) -> tuple[tuple[Segment, ...], DataFrame]:
        """The version's segments without the touched files, and the live rows of these files."""
        rest = tuple(r for s in version.segments if (r := self.store.without(s, hit[s]) if s in hit else s) is not None)
        old = self.store.read(version, tuple(replace(s, files=tuple(sorted(f))) for s, f in hit.items()))
        return rest, old.where(alive()) if any(s.expires for s in hit) else old

    def update(self, table: str, assignments: list[tuple[str, str]], where: str | None) -> int:
        """Rewrites the files that hold rows to change; returns how many rows were changed."""
        with self.store.lock(table):
            version = self.version(table)
            values = {}
            for name, text in assignments:
                if version.schema.column(name) is None:
                    raise EngineError(f"unknown column: {name}")
                values[name] = F.expr(text)
            condition = None if where is None else F.expr(where)
            hit, n = self._touched(version, condition)
            if n:
                rest, old = self._split(version, hit)
                key = version.schema.key
                path = self.store.write(version, dml.update(old, values, condition))
                self._replace(version, rest, path, hit, any(c.not_null and c.name in values for c in version.schema.columns), rest if key and key.name in values else None)
            return n

    def _replace(self, version: Version, rest: tuple[Segment, ...], path: str, hit: dict[Segment, set[str]], check: bool, beside: tuple[Segment, ...] | None) -> None:
        """Commits a version in which rows of the touched files were written anew. Without a check their bounds are kept, which hold still."""
        if check or any(s.expires for s in hit):
            new = self._checked(version, path, beside)
        else:
            spans = [s.keys for s in hit]
            new = Segment(path, 0, None, (min(s[0] for s in spans), max(s[1] for s in spans)) if all(spans) else None)
        self.store.commit(replace(version, segments=(*rest, *([new] if new else ()))))

    def delete(self, table: str, where: str | None) -> int:
        """Rewrites the files that hold rows to delete; returns how many rows went."""
        with self.store.lock(table):
            version = self.version(table)
            condition = None if where is None else F.expr(where)
            hit, n = self._touched(version, condition)
            if n:
                rest, old = self._split(version, hit)
                if condition is None:
                    self.store.commit(replace(version, segments=rest))
                else:
                    self._replace(version, rest, self.store.write(version, dml.delete(old, condition)), hit, False, None)
            return n

    def truncate(self, table: str) -> None:
        with self.store.lock(table):
            self.store.commit(replace(self.version(table), segments=()))

    def compact(self, table: str | None = None, keep: int = 1, age: float = 3600.0) -> None:
        """Rewrites live rows into one segment, and deletes what only versions list that were replaced over `age` seconds ago."""
        for name in [table.upper()] if table else self.tables():
            with self.store.lock(name):
                version = self.version(name)
                self._rewrite(version, version.segments)
                self.store.vacuum(name, keep, age)

    def sweep(self, table: str, many: int) -> bool:
        """Rewrites the segments that hold expired rows, or all of them if there are more than `many`; whether there was anything to do."""
        with self.store.lock(table):
            version, now = self.version(table), time.time()
            due = version.segments if len(version.segments) > many else tuple(s for s in version.segments if 0 < s.expires <= now or s.expires < 0)
            if due:
                self._rewrite(version, due)
                self.store.vacuum(table)
            return bool(due)

    def _rewrite(self, version: Version, due: tuple[Segment, ...]) -> None:
        if due:
            path = self.store.write(version, self.live(replace(version, segments=due), expiry=True))
            new = self._checked(version, path, None)
            self.store.commit(replace(version, segments=(*[s for s in version.segments if s not in due], *([new] if new else ()))))


INTEGER = re.compile(r"[+-]?[0-9]+")
DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)")
TENTH, LARGEST = Decimal("1e-10"), Decimal(10) ** 18
KEYS = 2000  # keys of a statement that are looked up by a filter


def _moment(value: Expression) -> Expression:
    """A text as a time: epoch seconds of five digits or more, or a form that Spark knows; NULL if it isn't one."""
    seconds = F.when(value.rlike(r"^[+-]?[0-9]{5,}$"), F.timestamp_seconds(value.try_cast("long")))
    return F.coalesce(seconds, F.when(~value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("timestamp")))


def _expiry(text: str | None) -> int:
    """Epoch seconds; what isn't a 64-bit integer is never."""
    value = int(text) if text is not None and INTEGER.fullmatch(text) else 0
    return value if -(1 << 63) <= value < 1 << 63 else 0


def _range(keys: pa.ChunkedArray) -> tuple[object, object] | None:
    ends = pc.min_max(keys).as_py() if not pa.types.is_timestamp(keys.type) else {"min": None, "max": None}
    return _kept_range(ends["min"], ends["max"]) or (None, None)


def _kept_range(lo: object, hi: object) -> tuple[object, object] | None:
    """Bounds that a manifest can hold."""
    return (lo, hi) if lo is not None and isinstance(lo, (int, str, Decimal)) else None


def _plain(value: object) -> str:
    text = str(value)
    return text.rstrip("0").rstrip(".") if "." in text else text
