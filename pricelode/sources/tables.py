"""Tables that batches change: rows in hash buckets with upserts, and history that is
appended once a batch.

Each write adds a folder of files and then one numbered commit file that says which folders
make up the table. Readers follow the highest commit, so they see a batch whole or not at
all, and a writer that dies leaves only files that no commit names. Two writers that commit
the same number: the second one fails and may begin again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from .writers import upsert


_FIXED = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


class Commits:
    """Numbered states of a table below `path`, in whatever store that names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.folder = self._path(f"{self.path}/commits")
        self.files = self.folder.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def numbers(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, number: int) -> dict:
        stream = self.files.open(self._path(self.folder, f"{number:010}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and state of the last commit; 0 and an empty one for a new table."""
        numbers = self.numbers()
        return (numbers[-1], self.state(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, state: dict) -> None:
        """Makes a state the one that counts, unless there is one of this number."""
        self.files.mkdirs(self.folder)
        draft = self._path(self.folder, f".{number}-{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(json.dumps(state).encode())
        stream.close()
        try:
            self._context.rename(draft, self._path(self.folder, f"{number:010}.json"), self._no_options)
        except Exception as e:
            self.files.delete(draft, False)
            raise RuntimeError(f"commit {number} of {self.path} was made by another writer; read the table and begin again") from e

    def folders(self, below: str) -> list[str]:
        """Names of the folders in a folder."""
        at = self._path(f"{self.path}/{below}")
        return [f.getPath().getName() for f in self.files.listStatus(at) if f.isDirectory()] if self.files.exists(at) else []

    def trim(self, keep: int, used) -> None:
        """Forgets all but the last `keep` commits, and folders of data older than the last
        commit that none of them uses. used: the names of folders that a state uses."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.files.delete(self._path(self.folder, f"{n:010}.json"), False)
        wanted = {f for n in numbers[-keep:] for f in used(self.state(n))}
        for name in self.folders("data"):
            # a folder of a later number may be another writer's, not yet committed
            if name not in wanted and int(name.split("=")[-1].split("-")[0]) <= numbers[-1]:
                self.files.delete(self._path(f"{self.path}/data/{name}"), True)


@dataclass(frozen=True)
class BucketTable:
    """Rows by key, dealt into `buckets` by the key's hash.

    Of the rows of one key the largest by `order` counts, the one written last if that is
    equal or empty. A batch is written as small files beside those of its buckets; a bucket
    of more than `most` such folders is rewritten as one. So a batch costs its own size and a
    share of the buckets it touches, whatever the table's size. Rows with a null key are left out.

    `by`, an SQL expression over the keys, deals rows into buckets by something else than the whole
    key; `split` tasks then write a bucket, as one of them may be large. Files are sorted by `sort`, so that
    ranges of it are read without the rest.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = 64
    most: int = 8
    keep: int = 2
    by: str | None = None
    split: int = 1
    sort: tuple[str, ...] = ()
    remember: int = 10_000

    def bucket(self) -> F.Column:
        of = [F.expr(self.by)] if self.by else [F.col(k) for k in self.keys]
        return F.pmod(F.xxhash64(*of), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame, by: list[str], written: str | None = None) -> DataFrame:
        """One row of each key."""
        place = F.struct(*[F.col(c) for c in (*self.order, *([written] if written else []))])
        rest = [c for c in rows.columns if c not in (*by, written)]
        if not rest:
            return rows.select(*by).distinct()
        if not self.order and all(isinstance(rows.schema[c].dataType, _FIXED) for c in rows.columns if c not in by):
            # values of fixed size are kept in hash tables, without a sort; all columns come from the same row
            own = lambda c: F.max_by(c, written) if written else F.first(c)
            return rows.groupBy(*by).agg(*[own(c).alias(c) for c in rest])
        row = F.struct(*[F.col(c) for c in rest])
        kept = F.max_by(row, place) if self.order or written else F.first(row)
        return rows.groupBy(*by).agg(kept.alias("_row")).select(*by, *[F.col("_row")[c].alias(c) for c in rest])

    def _write(self, spark: SparkSession, rows: DataFrame, log: Commits, number: int) -> tuple[str, list[str]]:
        """Rows in files by bucket: the folder, and the buckets that it has."""
        folder = f"{number:010}-{uuid.uuid4().hex[:8]}"
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.split))
        dealt = rows.dropna(subset=list(self.keys)).withColumn("_bucket", self.bucket()).withColumn("_part", part).repartition(self.buckets * self.split, "_bucket", "_part")
        # rows of a key are in one partition already
        last = self._last(dealt, ["_bucket", "_part", *self.keys]).drop("_part")
        (last.sortWithinPartitions("_bucket", *self.sort) if self.sort else last).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder, [n.split("=")[1] for n in log.folders(f"data/{folder}") if n.startswith("_bucket=")]

    def _files(self, spark: SparkSession, state: dict, buckets: list[str]) -> DataFrame:
        """The rows of some buckets, one of each key."""
        schema = StructType.fromJson(state["schema"])
        place = lambda f, b: f"{self.path}/data/{f}/_bucket={b}"
        single = [place(state["buckets"][b][0], b) for b in buckets if len(state["buckets"].get(b, [])) == 1]
        several = [place(f, b) for b in buckets if len(state["buckets"].get(b, [])) > 1 for f in state["buckets"][b]]
        out = spark.read.schema(schema).parquet(*single) if single else spark.createDataFrame([], schema)
        if several:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d{10})-[^/]*/_bucket=[^/]*/[^/]*$", 1).cast("long")
            rows = spark.read.schema(schema).parquet(*several).withColumn("_written", number)
            out = out.unionByName(self._last(rows, list(self.keys), "_written").select(*schema.names))
        return out

    def exists(self, spark: SparkSession) -> bool:
        return Commits(spark, self.path).latest()[0] > 0

    def read(self, spark: SparkSession, of: DataFrame | None = None) -> DataFrame:
        """The table as of its last commit; with `of`, which has the keys, only the buckets
        that may hold one of them. Buckets of one folder are read as they are, without a shuffle."""
        return self._files(spark, *self._chosen(spark, of))

    def values(self, spark: SparkSession, keys: list[str], of: DataFrame | None = None) -> DataFrame:
        """Distinct values of some of the keys, from the files that read() opens: a key's rows needn't be brought together for it."""
        state, buckets = self._chosen(spark, of)
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b in buckets for f in state["buckets"][b]]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows.select(*keys).distinct()

    def _chosen(self, spark: SparkSession, of: DataFrame | None) -> tuple[dict, list[str]]:
        """The state of the last commit, and the buckets that may hold one of the keys."""
        number, state = Commits(spark, self.path).latest()
        if not number:
            raise FileNotFoundError(f"{self.path} has no commit")
        buckets = list(state["buckets"])
        if of is not None:
            # as many rows as there are buckets
            asked = {str(r[0]) for r in of.select(self.bucket()).distinct().collect()}
            buckets = [b for b in buckets if b in asked]
        return state, buckets

    def has(self, spark: SparkSession, batch: str) -> bool:
        """Whether a named batch is in, of the last `remember` ones."""
        return batch in Commits(spark, self.path).latest()[1].get("batches", [])

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """Puts rows in; of a key that is there already the larger row by `order` stays. The
        number of the commit. Rows may lack columns of the table and bring new ones at its end. A batch
        that has a name is put in once."""
        spark = rows.sparkSession
        log = Commits(spark, self.path)
        number, state = log.latest()
        if batch is not None and batch in state.get("batches", []):
            return number
        if number and state["layout"] != self._layout():
            raise ValueError(f"{self.path} was written with {state['layout']}, not {self._layout()}")
        folder, touched = self._write(spark, rows, log, number + 1)
        lists = {b: list(f) for b, f in state.get("buckets", {}).items()}
        for b in touched:
            lists.setdefault(b, []).append(folder)
        schema = rows.schema if not number else StructType.fromJson(state["schema"])
        schema = StructType([*schema.fields, *[f for f in rows.schema.fields if f.name not in schema.names]])
        # what is missing in one file or another may be null
        batches = [*state.get("batches", []), *([batch] if batch is not None else [])][-self.remember :]
        state = {"layout": self._layout(), "batches": batches, "schema": StructType([type(f)(f.name, f.dataType, True) for f in schema.fields]).jsonValue(), "buckets": lists}
        log.commit(number + 1, state)
        return self.compact(spark)

    def upsert(self, updates: DataFrame, update_columns: list[str] | None = None, insert_defaults: dict | None = None) -> int:
        """What writers.upsert() makes of the table and the updates is put in. Only the buckets of
        the updates' keys are read, and only rows of these keys are written."""
        old = self.read(updates.sparkSession, updates).join(updates.select(*self.keys).distinct(), list(self.keys), "left_semi")
        return self.append(upsert(old, updates, list(self.keys), update_columns, insert_defaults))

    def compact(self, spark: SparkSession, most: int | None = None) -> int:
        """Rewrites the buckets of more than `most` folders as one; the number of the last commit."""
        log = Commits(spark, self.path)
        number, state = log.latest()
        full = [b for b, f in state.get("buckets", {}).items() if len(f) > (self.most if most is None else most)]
        if full:
            folder, found = self._write(spark, self._files(spark, state, full), log, number + 1)
            lists = {b: f for b, f in state["buckets"].items() if b not in full} | {b: [folder] for b in found}
            number += 1
            log.commit(number, {**state, "buckets": lists})
        log.trim(self.keep, lambda s: {f for own in s["buckets"].values() for f in own})
        return number

    def _layout(self) -> dict:
        return {"keys": list(self.keys), "order": list(self.order), "buckets": self.buckets, "by": self.by}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or for a local session without it a temporary one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class BatchHistory:
    """Rows that are only ever added, in batches that have names; by month of `time`.

    A batch that is appended again, as after a failure, is written once: the commit names
    the batches that are in. Every `most` batches their files become one folder. The names are kept for
    the last `remember` batches; a batch may be repeated within that many.
    """

    path: str
    time: str = "recorded_at"
    most: int = 32
    remember: int = 10_000
    keep: int = 2

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Whether the batch was new."""
        spark = rows.sparkSession
        log = Commits(spark, self.path)
        number, state = log.latest()
        if batch in state.get("batches", []):
            return False
        folder = self._write(rows, number + 1)
        schema = state.get("schema") or rows.schema.jsonValue()
        log.commit(number + 1, {"schema": schema, "batches": [*state.get("batches", []), batch][-self.remember :], "folders": [*state.get("folders", []), folder]})
        self._compact(spark, log)
        return True

    def _write(self, rows: DataFrame, number: int, gather: bool = False) -> str:
        folder = f"_folder={number:010}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn("_month", F.date_format(self.time, "yyyy-MM"))
        # Spark gathers small months into few files and splits large ones
        (dealt.hint("rebalance", "_month") if gather else dealt).write.partitionBy("_month").parquet(f"{self.path}/data/{folder}")
        return folder

    def _compact(self, spark: SparkSession, log: Commits) -> None:
        number, state = log.latest()
        # folders of batches are merged level by level, so a row is rewritten a logarithm of times
        level = state.get("levels", {})
        for k in sorted(set(level.values()) | {0}):
            own = [f for f in state["folders"] if level.get(f, 0) == k]
            if len(own) >= self.most:
                folder = self._write(self._read(spark, state, own), number + 1, True)
                folders = [folder, *[f for f in state["folders"] if f not in own]]
                level = {f: n for f, n in level.items() if f in folders} | {folder: k + 1}
                number, state = number + 1, {**state, "folders": folders, "levels": level}
                log.commit(number, state)
        log.trim(self.keep, lambda s: set(s["folders"]))

    def _read(self, spark: SparkSession, state: dict, folders: list[str], first_month: str | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        rows = spark.read.schema(StructType([*schema.fields]).add("_folder", "string").add("_month", "string")).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])
        return (rows if first_month is None else rows.where(F.col("_month") >= first_month)).select(*schema.names)

    def read(self, spark: SparkSession, first_month: str | None = None) -> DataFrame:
        """All rows of committed batches; from a month on (yyyy-MM), without reading earlier ones."""
        number, state = Commits(spark, self.path).latest()
        if not number:
            raise FileNotFoundError(f"{self.path} has no commit")
        return self._read(spark, state, state["folders"], first_month)
