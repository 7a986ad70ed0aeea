"""Tables with committed versions: several tables under one root change together, or not at all.

A version is one small JSON file that names, for each table, its schema, the rule by which rows are dealt to parts (say, a
part a day), and the folder of each part. A writer first writes the parts that it changes into folders of its own, then
the version file by a rename that fails if that version exists. So readers see whole versions only; a writer that is
killed leaves folders that no version names; and of two writers with the same base one wins and the other builds its change
again on what the winner has left. An upsert reads and writes the parts that its rows are in, and no other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"
NO_PART = "-"  # of rows for which the rule gives null or nothing


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Files:
    """The few file operations that versions need, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, file: str, text: str) -> None:
        stream = self.fs.create(self.path(file), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, temporary: str, file: str) -> None:
        """Rename; a file that is there already stays, and that is a conflict."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(temporary), self.path(file), how)
        except Exception as e:
            if self.fs.exists(self.path(file)):
                self.fs.delete(self.path(temporary), False)
                raise Conflict(file) from e
            raise


class Change:
    """What a writer changes, on top of a base version. Tables that it doesn't touch stay as they are."""

    def __init__(self, store: Versions, base: int, manifest: dict):
        self.store, self.base = store, base
        self.tables = {name: {**t, "parts": dict(t["parts"])} for name, t in manifest.items()}

    def read(self, table: str) -> DataFrame:
        return self.store._read(self.tables, table)

    def replace(self, table: str, df: DataFrame, part: str | None = None) -> None:
        """The whole table. part: SQL for the name of a row's part; none: one part."""
        rule = part or f"'{NO_PART}'"
        self.tables[table] = {"schema": json.loads(df.schema.json()), "part": rule, "parts": self.store._write(table, df, rule)}

    def upsert(self, table: str, incoming: DataFrame, keys, part: str | None = None) -> None:
        """Rows with new keys are added, others replaced. incoming has at most one row a key (see ``newest``)."""
        if table not in self.tables:
            return self.replace(table, incoming, part)
        known = self.tables[table]
        schema = StructType.fromJson(known["schema"])
        if missing := [f.name for f in schema.fields if f.name not in incoming.columns]:
            raise ValueError(f"columns are missing: {missing}")
        if part is not None and part != known["part"]:
            raise ValueError(f"{table} is dealt to parts by {known['part']}")
        new = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        touched = {r[0] for r in _with_part(new, known["part"]).select(PART).distinct().collect()}  # names of parts
        old = self.store._read(self.tables, table, touched)
        merged = old.join(new, list(keys), "left_anti").select(*schema.names).unionByName(new)
        # a key whose part has changed leaves its old part only if that is touched; parts are made of keys
        known["parts"].update(self.store._write(table, merged, known["part"]))

    def drop_parts(self, table: str, names) -> None:
        for name in names:
            self.tables[table]["parts"].pop(name, None)


def newest(df: DataFrame, keys, by) -> DataFrame:
    """Of rows with the same key, the one that is greatest by the given columns."""
    rest = [c for c in df.columns if c not in keys and c not in by]
    best = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def _with_part(df: DataFrame, rule: str) -> DataFrame:
    return df.withColumn(PART, F.coalesce(F.expr(f"nullif(cast(({rule}) AS string), '')"), F.lit(NO_PART)))


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def _version_file(self, version: int) -> str:
        return f"{self.root}/_versions/{version:012d}.json"

    def latest(self) -> int:
        """0 before the first commit."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads(self.files.read(self._version_file(version)))["tables"] if version else {}

    def history(self) -> list[dict]:
        return [{k: v for k, v in json.loads(self.files.read(self._version_file(n))).items() if k != "tables"} for n in range(1, self.latest() + 1)]

    def read(self, table: str, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
        """A table as of a version (the latest), of its parts those named first to last: other parts' files are not listed."""
        tables = self.manifest(version)
        names = None
        if first is not None or last is not None:
            names = {n for n in tables[table]["parts"] if (first is None or n >= first) and (last is None or n <= last)}
        return self._read(tables, table, names)

    def _read(self, tables: dict, table: str, names=None) -> DataFrame:
        if table not in tables:
            raise ValueError(f"there is no table {table}")
        known = tables[table]
        schema = StructType.fromJson(known["schema"])
        paths = [p for n, p in sorted(known["parts"].items()) if names is None or n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _write(self, table: str, df: DataFrame, rule: str) -> dict[str, str]:
        """Writes df into a folder of its own: name of each part -> its folder. Large parts are split between tasks."""
        folder = f"{table}/{uuid.uuid4().hex}"
        _with_part(df, rule).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.root}/{folder}")
        found = [n for n in self.files.names(f"{self.root}/{folder}") if n.startswith(f"{PART}=")]
        return {unquote(n[len(PART) + 1 :]): f"{folder}/{n}" for n in found}

    def commit(self, build: Callable[[Change], None], note: str = "", attempts: int = 5) -> int:
        """Lets build change tables on top of the latest version and publishes the result; after a conflict, again on the new
        latest version. Returns the version."""
        for attempt in range(attempts):
            base = self.latest()
            change = Change(self, base, self.manifest(base))
            build(change)
            temporary = f"{self.root}/_versions/.{uuid.uuid4().hex}"
            self.files.write(temporary, json.dumps({"version": base + 1, "note": note, "tables": change.tables}, sort_keys=True))
            try:
                self.files.publish(temporary, self._version_file(base + 1))
                return base + 1
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError


def unnamed_folders(store: Versions) -> list[str]:
    """Folders that no version names: of writers that were killed, lost a race, or still write."""
    named = {p.rsplit("/", 1)[0] for n in range(1, store.latest() + 1) for t in store.manifest(n).values() for p in t["parts"].values()}
    tables = [n for n in store.files.names(store.root) if not n.startswith(("_", "."))]
    return [f"{t}/{n}" for t in tables for n in store.files.names(f"{store.root}/{t}") if f"{t}/{n}" not in named]
