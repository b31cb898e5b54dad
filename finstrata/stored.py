"""Stored tables that a batch changes in place (SNK-1..5, SNK-13) and tables derived from them (INC-4).

Rows lie in folders by a hash of their company (or other key). A write merges the buckets its batch touches with Spark
and puts them beside the old ones; a version file then names the folder of every bucket. Until that file stands readers
see the table as it was, so a write that dies leaves it readable, and one that is repeated with its batch id does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finstrata.sinks import TABLE_RULES, write_rows

BUCKET, WRITE = "__bucket", "__write"


class Outrun(RuntimeError):
    """Another write was committed first; the batch can be written again."""


@dataclass(frozen=True)
class Version:
    """One committed state: the folder of each bucket that has rows, the batches stored so far, and for a derived table
    the folders its sources had."""
    number: int = 0
    schema: str | None = None
    folders: Mapping[str, str] = field(default_factory=dict)
    batches: tuple[str, ...] = ()
    sources: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


class StoredTable:
    """The table *name* (its rule is in ``TABLE_RULES``) under *root*, cut into *buckets* by the first key of its rule.

    Keep a bucket near a few GB: the number is fixed when the table is first written. Null keys share a bucket; as they
    equal nothing, upserts add their rows. A batch of no rows commits nothing but its id.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 64, key: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = f"{root.rstrip('/')}/{name}"
        self.key = key or TABLE_RULES[name][1][0]
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def version(self) -> Version:
        """The latest committed state."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return Version()
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        done = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not done:
            return Version()
        state = json.loads(self.spark.read.text(f"{self.path}/versions/{max(done)}", wholetext=True).first()[0])
        if state.pop("buckets") != self.buckets:
            raise ValueError(f"{self.path} is cut into another number of buckets")
        return Version(**{**state, "batches": tuple(state["batches"])})

    def _commit(self, v: Version) -> None:
        """Names the new version by a rename that fails if another write took the number."""
        final = self._path(f"{self.path}/versions/{v.number:010d}.json")
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({**v.__dict__, "buckets": self.buckets}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        strict = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, strict)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Outrun(f"version {v.number} of {self.path} was committed by another write") from e
            raise

    def read(self, buckets: Iterable[int] | None = None, at: Version | None = None) -> DataFrame:
        """The rows of the latest version (or *at*), of some *buckets* only if given; other folders are not listed."""
        v = at or self.version()
        if v.schema is None:
            raise ValueError(f"nothing is stored at {self.path}")
        schema = StructType.fromJson(json.loads(v.schema))
        wanted = v.folders if buckets is None else {str(b): v.folders[str(b)] for b in buckets if str(b) in v.folders}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{f}" for f in wanted.values()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop(BUCKET, WRITE)

    def _put(self, rows: DataFrame, schema: StructType) -> dict[str, str]:
        """Writes *rows* by bucket to a folder of their own; large buckets are cut into several files by the adaptive plan."""
        here = f"{WRITE}={uuid.uuid4().hex}"
        cells = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        out = rows.select(*cells).withColumn(BUCKET, self._bucket())
        out.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{here}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/data/{here}"))]
        return {n.split("=")[1]: f"{here}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _next(self, v: Version, touched: Iterable[int], put: dict[str, str], schema: StructType, batch_id: str | None, sources: Mapping) -> Version:
        gone = {str(b) for b in touched}
        kept = {b: f for b, f in v.folders.items() if b not in gone}
        return Version(v.number + 1, schema.json(), {**kept, **put}, v.batches + ((batch_id,) if batch_id else ()), sources)

    def write(self, batch: DataFrame, batch_id: str) -> Version:
        """Stores *batch* by the table's rule, once: a *batch_id* that was stored before changes nothing.

        Only the buckets that the batch has rows in are read and written. The batch is computed once, into a folder.
        """
        v = self.version()
        if batch_id in v.batches:
            return v
        landed = f"{self.path}/batches/{uuid.uuid4().hex}"
        batch.write.parquet(landed)
        batch = self.spark.read.schema(batch.schema).parquet(landed)
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # numbers below `buckets`
        old = self.spark.createDataFrame([], batch.schema) if v.schema is None else self.read(touched, v)
        rows = write_rows(self.name, old, batch)
        schema = self._wider(v, rows.schema)
        new = self._next(v, touched, self._put(rows, schema) if touched else {}, schema, batch_id, v.sources)
        self._commit(new)
        return new

    @staticmethod
    def _wider(v: Version, now: StructType) -> StructType:
        """Columns stored before, then those a batch adds; older folders give them as NULL."""
        if v.schema is None:
            return now
        old = StructType.fromJson(json.loads(v.schema))
        return StructType(old.fields + [f for f in now.fields if f.name not in old.names])

    def refresh(self, sources: Mapping[str, StoredTable], compute: Callable[[dict[str, DataFrame]], DataFrame]) -> list[int]:
        """Brings a derived table up to its *sources* and returns the buckets computed.

        A bucket is computed again if its folder in any source isn't the one that the table was derived from; *compute*
        gets the sources' rows of those buckets, which hold all rows of their companies, and its rows replace the buckets.
        A rule across companies (ranks) belongs after, over the whole derived table.
        """
        if any(s.buckets != self.buckets or s.key != self.key for s in sources.values()):
            raise ValueError("derived tables and their sources share key and buckets")
        v, now = self.version(), {n: s.version() for n, s in sources.items()}
        seen = lambda n: v.sources.get(n, {})
        touched = sorted({int(b) for n, s in now.items() for b in {*s.folders, *seen(n)} if s.folders.get(b) != seen(n).get(b)})
        if not touched:
            return []
        rows = compute({n: sources[n].read(touched, s) for n, s in now.items()})
        schema = self._wider(v, rows.schema)
        self._commit(self._next(v, touched, self._put(rows, schema), schema, None, {n: dict(s.folders) for n, s in now.items()}))
        return touched

    def vacuum(self) -> None:
        """Deletes batches and folders that the latest version doesn't name; run it when no reader or writer is active."""
        named = {f.split("/")[0] for f in self.version().folders.values()}
        for sub, keep in (("data", named), ("batches", set())):
            folder = self._path(f"{self.path}/{sub}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f.getPath().getName() not in keep:
                    self._fs.delete(f.getPath(), True)
