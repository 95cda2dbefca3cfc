"""A store of survey tables that are replaced together or not at all: staged writes, and a manifest of versions committed last."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that the surveys of a table are dealt to by a hash; a change rewrites only those of the surveys it touches.
BUCKETS = 64
BUCKET = "_bucket"
#: Columns of a registered report.
REPORTS = "report_id string, survey_id string, format string, path string, size_bytes long, created_at timestamp"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, only a session in one process gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="deepledger-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(place)
    return f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again; what was shuffled for them is deleted at once."""
    spark, path, release = rows.sparkSession, shared_folder(rows.sparkSession, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(release, None)
    spark.conf.set(release, "true")
    try:
        rows.select("*").write.parquet(path)
    finally:
        spark.conf.set(release, before) if before is not None else spark.conf.unset(release)
    return spark.read.schema(rows.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer committed the version that this one was to be; nothing of this one is visible."""


@dataclass
class Change:
    """New rows of a table. Old rows go that share their values of `key`, or those of a row in `replaced`.

    `replaced` also names what is to be empty afterwards, such as a survey whose navigation has no valid fix left.
    """

    rows: DataFrame
    key: list[str]
    replaced: DataFrame | None = None


@dataclass
class Manifest:
    """What one version consists of: for each table its schema and the folder of each bucket."""

    version: int = 0
    buckets: int = BUCKETS
    schemas: dict[str, str] = field(default_factory=dict)
    folders: dict[str, dict[str, str]] = field(default_factory=dict)

    def text(self) -> str:
        body = json.dumps({"version": self.version, "buckets": self.buckets, "schemas": self.schemas, "folders": self.folders}, sort_keys=True)
        return f"{body}\n{len(body)}\n"

    @staticmethod
    def of(text: str) -> Manifest | None:
        """The manifest of a file's text; None if the file was not written to its end."""
        lines = text.split("\n")
        if len(lines) != 3 or lines[1] != str(len(lines[0])):
            return None
        return Manifest(**json.loads(lines[0]))


class Store:
    """Survey tables below a folder of any file system that Spark writes to.

    A publication stages the rows of the buckets that it touches in a folder of its own, table by table, and then creates the
    manifest of the next version, with exclusive creation, so that two writers cannot both be that version. Readers take the
    newest manifest that is whole. A job that fails, or a driver that dies, before that leaves the former version as it was, and
    an unread folder that `clean` removes. Folders never change once they are written, so that a reader of an older version is
    not disturbed.

    Every table has a column `survey_id`; its null values are a survey. A survey's rows lie in one bucket, but are written by as
    many tasks as their size asks for.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- files

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, files = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []

    def _read(self, path: str) -> str:
        where, files = self._files(path)
        stream = files.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size_of(self, path: str) -> int:
        """Bytes of all files below a path."""
        where, files = self._files(path)
        return files.getContentSummary(where).getLength()

    # --- versions

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest whole manifest, or that of a version; before the first publication one of no tables."""
        for name in reversed(self._names(f"{self.path}/versions")):
            if (found := re.fullmatch(r"(\d{12})\.json", name)) and version in (None, int(found[1])) and (held := Manifest.of(self._read(f"{self.path}/versions/{name}"))):
                return held
        if version is not None:
            raise KeyError(f"no whole version {version}")
        return Manifest(buckets=self.buckets)

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table as of a version (the newest by default); None if it has no such table. buckets: only those."""
        return self._table(self.manifest(version), table, buckets)

    def _table(self, manifest: Manifest, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        if table not in manifest.schemas:
            return None
        schema = StructType.fromJson(json.loads(manifest.schemas[table]))
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/{folder}" for bucket, folder in sorted(manifest.folders[table].items()) if wanted is None or bucket in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, expected: int | None = None, /, **changes: Change) -> int:
        """Makes all changes visible at once as the next version, which is returned; all or nothing.

        A table that does not exist yet is created. Columns are those of the table, in any order; others are an error.
        expected: the version that the changes were made from; if another one is the newest by now, that is a conflict.
        """
        base = self.manifest()
        if expected not in (None, base.version):
            raise Conflict(f"version {base.version} is newer than {expected}")
        token = uuid.uuid4().hex
        after = self._next(base)
        for table, change in changes.items():
            self._stage(base, after, table, change, f"data/{token}/{table}")
        self._commit(after)
        return after.version

    def _next(self, base: Manifest) -> Manifest:
        """A copy of a manifest as the next version."""
        taken = [int(n[:12]) for n in self._names(f"{self.path}/versions") if re.fullmatch(r"\d{12}\.json", n)]
        return Manifest(max([base.version, *taken]) + 1, base.buckets, dict(base.schemas), {k: dict(v) for k, v in base.folders.items()})

    def _stage(self, base: Manifest, after: Manifest, table: str, change: Change, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(F.col("survey_id").cast("string")), F.lit(base.buckets)).cast("int")
        if "survey_id" not in change.key:
            raise ValueError("the key of a change holds survey_id")
        rows = change.rows
        if table not in base.schemas:  # nothing to replace, so that the rows are read once
            after.schemas[table] = rows.schema.json()
            after.folders[table] = self._write(rows, bucket, folder)
            return
        keys = rows.select(*change.key)
        if change.replaced is not None:
            keys = keys.unionByName(change.replaced.select(*change.key))
        keys = keys.distinct()
        touched = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]  # numbers below `buckets`
        old = self._table(base, table, touched)
        if set(rows.columns) != set(old.columns):
            raise ValueError(f"columns of {table} are {old.columns}, not {rows.columns}")
        gone = keys.select(*[F.col(c).alias(f"_{c}") for c in change.key])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in change.key]
        written = self._write(old.join(gone, same, "left_anti").unionByName(rows), bucket, folder)
        after.folders[table] = {b: f for b, f in after.folders[table].items() if b not in set(map(str, touched))} | written

    def _write(self, rows: DataFrame, bucket: Column, folder: str) -> dict[str, str]:
        """Writes rows below a folder of the store by bucket; the folder of each bucket that has rows."""
        staged = rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
        staged.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")}

    def _commit(self, manifest: Manifest) -> None:
        where, files = self._files(f"{self.path}/versions/{manifest.version:012d}.json")
        try:
            stream = files.create(where, False)
        except Exception as e:
            if files.exists(where):
                raise Conflict(f"version {manifest.version} exists") from e
            raise
        try:
            stream.write(bytearray(manifest.text().encode()))
        finally:
            stream.close()

    def clean(self, keep: int = 1) -> list[str]:
        """Removes the folders that none of the newest `keep` whole versions holds, and returns their names. No writer may be at work."""
        whole = [m for n in self._names(f"{self.path}/versions") if (m := Manifest.of(self._read(f"{self.path}/versions/{n}")))]
        held = {folder.split("/")[1] for m in whole[-keep:] for folders in m.folders.values() for folder in folders.values()}
        gone = [n for n in self._names(f"{self.path}/data") if n not in held]
        for name in gone:
            where, files = self._files(f"{self.path}/data/{name}")
            files.delete(where, True)
        return gone

    # --- what the survey tables need

    def update(self, table: str, rows: DataFrame, key: list[str], columns: tuple[str, ...]) -> int:
        """Partial update: rows (key and some of `columns`) overwrite values of existing rows; null overwrites nothing.

        Columns outside the list of those that may change are an error; rows of an unknown key do nothing.
        """
        extra = set(rows.columns) - set(key) - set(columns)
        if extra:
            raise ValueError(f"not to be updated: {sorted(extra)}")
        manifest = self.manifest()
        bucket = F.pmod(F.xxhash64(F.col("survey_id").cast("string")), F.lit(manifest.buckets)).cast("int")
        if table not in manifest.schemas:
            raise KeyError(table)
        # the rows are written by bucket first, which tells the buckets to rewrite; then one join makes these
        after, token = self._next(manifest), uuid.uuid4().hex
        if folders := self._write(rows, bucket, f"data/{token}/_{table}"):
            new = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])
            new = new.select(*key, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in key])
            old = self._table(manifest, table, map(int, folders))
            merged = old.join(new, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c) for c in old.columns])
            after.folders[table] |= self._write(merged, bucket, f"data/{token}/{table}")
        self._commit(after)
        return after.version

    def write_report(self, rows: DataFrame, survey_id: str, kind: str, now: datetime | None = None) -> str:
        """Writes a report (csv, json or text, as many files as tasks) and registers it with its path and size; returns its id.

        A writer that fails registers nothing. `reports` holds what is registered.
        """
        report = f"rep_{uuid.uuid4().hex[:12]}"
        path = f"{self.path}/reports/{report}.{kind}"
        writer = rows.write
        {"csv": lambda: writer.option("header", True).option("emptyValue", "").csv, "json": lambda: writer.option("ignoreNullFields", "false").json, "text": lambda: writer.text}[kind]()(path)
        row = (report, str(survey_id), kind, path, self.size_of(path), now or datetime.now(timezone.utc).replace(tzinfo=None))
        self.publish(reports=Change(self.spark.createDataFrame([row], REPORTS), ["survey_id", "report_id"]))
        return report
