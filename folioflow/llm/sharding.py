"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and numbered manifests. An arrival is
appended as small shards, one for each partition in which it comes. Tier t holds shards of
up to ``fanout**t`` times the smallest size; when a tier has ``fanout`` shards or more, they are
merged into shards of the next tier, and the last tier's are of the target size. A merge
is a scan whose tasks take shards of as many bytes as a file of the next tier holds, so each
writes one file, and nothing is shuffled.

A manifest lists the segments of one version, and a segment lists shards. Segments never change: a commit writes one for
what is new and for what is left of segments that lost shards, and takes over the others, so it costs what has
changed. A manifest is committed by renaming a finished file
to the version's name, which fails if that name exists: a writer that loses the race takes
the new manifest, and does it again. Readers see one version or the next, never files
of a job that did not end; those are removed by vacuum(). On object stores without an
atomic rename, ``commit`` needs a conditional put instead.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import private, shared_dir

ARRIVALS = 5
#: Shards of a segment at most, and segments of under half of that beyond which they are written as one.
SEGMENT, FEW = 1000, 16
SMALLEST = 2 << 20
FANOUT = 4
TARGET = 128 << 20


@dataclass(frozen=True)
class Shard:
    """A file; of: how many its job wrote, so that all of them can be read as their folder."""

    name: str
    tier: int
    size: int
    of: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    """Shards and manifests under one folder that all executors reach.

    Rows are kept as they come: nulls, repeated rows and any columns. All arrivals must
    have the same schema. An empty arrival adds no shard, and a store without shards reads
    as an empty table.
    """

    def __init__(self, spark: SparkSession, root: str, smallest: int = SMALLEST, fanout: int = FANOUT, target: int = TARGET):
        self.spark, self.root, self.smallest, self.fanout, self.target = spark, root.rstrip("/"), smallest, fanout, target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        #: of the manifest that was read last
        self._segments: dict[str, tuple[Shard, ...]] = {}

    @classmethod
    def create(cls, spark: SparkSession, root: str | None = None, **sizes: int) -> ShardStore:
        store = cls(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", **sizes)
        store._fs.mkdirs(store._at("manifests"))
        return store

    def _at(self, *names: str):
        return self._path("/".join([self.root, *names]))

    def tier(self, size: int) -> int:
        """0 up to the smallest size, then one more for every factor of fanout; shards of over half the target are done."""
        if size > self.target // 2:
            return self.last
        return min(self.last - 1, max(0, math.ceil(math.log(max(size, 1) / self.smallest, self.fanout))))

    @property
    def last(self) -> int:
        return max(1, math.ceil(math.log(self.target / self.smallest, self.fanout)))

    # manifests

    def manifest(self) -> Manifest | None:
        """The newest version."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return None
        raw = self._get("manifests", f"{max(versions):012d}.json")
        self._segments = {name: self._segments.get(name) or tuple(Shard(**s) for s in self._get("manifests", name)) for name in raw["segments"]}
        return Manifest(raw["version"], raw["schema"], tuple(s for shards in self._segments.values() for s in shards))

    def _get(self, *names: str):
        stream = self._fs.open(self._at(*names))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, value, *names: str) -> None:
        stream = self._fs.create(self._at(*names))
        stream.write(bytearray(json.dumps(value), "utf-8"))
        stream.close()

    def _segmented(self, shards: tuple[Shard, ...]) -> dict[str, tuple[Shard, ...]]:
        """Shards in segments: those of before that are whole, and new ones, which are written."""
        wanted = set(shards)
        whole = {name: own for name, own in self._segments.items() if wanted.issuperset(own)}
        small = [name for name, own in whole.items() if len(own) < SEGMENT // 2]
        for name in small if len(small) > FEW else ():
            del whole[name]
        taken = {s for own in whole.values() for s in own}
        rest = [s for s in shards if s not in taken]
        for at in range(0, len(rest), SEGMENT):
            name, own = f"segment-{uuid.uuid4().hex}", tuple(rest[at : at + SEGMENT])
            self._put([asdict(s) for s in own], "manifests", name)
            whole[name] = own
        return whole

    def commit(self, new: Manifest) -> Manifest:
        """Make a manifest the newest, whole or not at all; as it is stored."""
        segments = self._segmented(new.shards)
        staged, name = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{new.version:012d}.json")
        self._put({"version": new.version, "schema": new.schema, "segments": list(segments)}, "manifests", staged.getName())
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self._jvm.org.apache.hadoop.fs.Options.Rename
            context.rename(staged, name, self.spark.sparkContext._gateway.new_array(none, 0))  # unlike FileSystem.rename, this never overwrites
        except Exception as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(new.version)) from None
            raise
        self._segments = segments
        return Manifest(new.version, new.schema, tuple(s for shards in segments.values() for s in shards))

    def _change(self, added: list[Shard], removed: set[str], schema: str) -> Manifest:
        """Commit added and removed on top of whatever is newest; a removed shard that another writer has removed already is a conflict."""
        while True:
            now = self.manifest()
            old = now.shards if now else ()
            if not removed <= {s.name for s in old}:
                raise Conflict("merged by another writer")
            new = Manifest((now.version if now else 0) + 1, now.schema if now else schema, (*(s for s in old if s.name not in removed), *added))
            try:
                return self.commit(new)
            except Conflict:
                continue

    # shards

    def _write(self, df: DataFrame) -> list[Shard]:
        """The shards that a job writes: its files, once it has ended."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._listed(folder)

    def _listed(self, folder: str) -> list[Shard]:
        files = [s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-")]
        return [Shard(f"{folder}/{s.getPath().getName()}", self.tier(s.getLen()), s.getLen(), len(files)) for s in files]

    def append(self, arrival: DataFrame) -> Manifest:
        """Add an arrival as small shards."""
        added, schema = self._write(arrival), arrival.schema.json()
        # a job writes no file for an empty partition, except for the first one
        none = [s for s in added if "/part-00000-" in s.name and self._load([s], schema).isEmpty()]
        return self._change([s for s in added if s not in none], set(), schema)

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int) -> Iterator[Manifest]:
        """Add rows as several arrivals, by a number from 0 on (null is 0, larger ones begin anew), which one job writes apart; each is added when the next manifest is asked for."""
        column, staged = private(rows.columns, "arrival")["arrival"], f"staged/{uuid.uuid4().hex}"
        rows.withColumn(column, F.pmod(F.coalesce(arrival, F.lit(0)), F.lit(arrivals))).write.partitionBy(column).parquet(f"{self.root}/{staged}")
        self._fs.mkdirs(self._at("data"))
        for k in range(arrivals):
            folder, own = f"data/{uuid.uuid4().hex}", self._at(staged, f"{column}={k}")
            added = []
            if self._fs.exists(own):
                self._fs.rename(own, self._at(folder))
                added = self._listed(folder)
            yield self._change(added, set(), rows.schema.json())
        self._fs.delete(self._at(staged), True)

    def _load(self, shards: Sequence[Shard], schema: str, split: int | None = None) -> DataFrame:
        """The rows of some shards; split: the bytes of files that a task reads. Where all files of a job are wanted its folder is named."""
        from pyspark.sql.types import StructType

        folders: dict[str, list[Shard]] = {}
        for s in shards:
            folders.setdefault(s.name.rpartition("/")[0], []).append(s)
        names = [n for folder, own in folders.items() for n in ([folder] if len(own) == own[0].of else [s.name for s in own])]
        fields = StructType.fromJson(json.loads(schema))
        if not names:
            return self.spark.createDataFrame([], fields)
        session = self.spark
        if split:
            session = self.spark.newSession()  # settings of its own
            for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 0), ("minPartitionNum", 1)):
                session.conf.set(f"spark.sql.files.{key}", value)
        return session.read.schema(fields).parquet(*[f"{self.root}/{n}" for n in names])

    def compact(self) -> int:
        """Merge every tier that is full, from the lowest up; the number of merges."""
        merges = 0
        for tier in range(self.last):
            now = self.manifest()
            full = [s for s in now.shards if s.tier == tier] if now else []
            if len(full) < self.fanout:
                continue
            wanted = min(self.target, self.smallest * self.fanout ** (tier + 1))
            merged = self._write(self._load(full, now.schema, split=wanted))
            # a merged shard has risen, whatever compression made of its size
            merged = [replace(s, tier=max(s.tier, tier + 1)) for s in merged]
            self._change(merged, {s.name for s in full}, now.schema)
            merges += 1
        return merges

    def vacuum(self) -> int:
        """Delete files that the newest manifest does not list, and older manifests. For times without writers and readers of old versions."""
        now = self.manifest()
        if now is None:
            return 0
        listed, removed = {s.name for s in now.shards}, 0
        if self._fs.exists(self._at("data")):
            for job in self._fs.listStatus(self._at("data")):
                files = [s.getPath() for s in self._fs.listStatus(job.getPath())]
                live = [f for f in files if f"data/{job.getPath().getName()}/{f.getName()}" in listed]
                for f in [f for f in files if f not in live] if live else [job.getPath()]:
                    removed += bool(self._fs.delete(f, True))
        for s in self._fs.listStatus(self._at("manifests")):
            if s.getPath().getName() not in (f"{now.version:012d}.json", *self._segments):
                removed += bool(self._fs.delete(s.getPath(), False))
        return removed

    def read(self, with_shard: bool = False) -> DataFrame:
        """The rows of the newest version; with_shard adds shard (its place in the manifest), tier and version, with a "_" after names that are taken."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"no manifest in {self.root}")
        rows = self._load(now.shards, now.schema)
        if not with_shard:
            return rows
        names = {}
        for c in ("shard", "tier", "version"):
            names[c] = c
            while names[c].lower() in {x.lower() for x in rows.columns}:
                names[c] += "_"
        if not now.shards:
            return rows.select("*", *[F.lit(None).cast("int").alias(c) for c in names.values()])
        # one row per shard of the manifest, which the driver holds anyway
        file = private([*rows.columns, *names.values()], "file")["file"]
        listed = self.spark.createDataFrame([(s.name.rsplit("/", 1)[-1], i, s.tier, now.version) for i, s in enumerate(now.shards)], f"{file} string, {names['shard']} int, {names['tier']} int, {names['version']} int")
        return rows.withColumn(file, F.element_at(F.split(F.input_file_name(), "/"), -1)).join(F.broadcast(listed), file).drop(file)


def in_arrivals(docs: DataFrame, arrivals: int = ARRIVALS, **sizes: int) -> tuple[ShardStore, int]:
    """A store to which docs came in several arrivals, compacted after each and rid of what was merged; and the number of merges."""
    store, merges = ShardStore.create(docs.sparkSession, **sizes), 0
    for _ in store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), arrivals):
        merges += store.compact()
        store.vacuum()
    return store, merges
