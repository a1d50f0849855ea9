"""Size-tiered shards under a versioned manifest (DataFrame functions only).

``Store.append`` writes an arrival as small immutable Parquet files, without a shuffle, and
commits a manifest that lists them beside those of before.  ``Store.compact`` puts files
below half the target in tiers of similar size (the largest at most ``RATIO`` times the
smallest), merges the tiers of at least ``fan_in`` files into files of about
``target_bytes``, by reading several files into one task, again without a shuffle, and
commits the manifest that names the new files instead.  Files
are never changed; readers see one version or another whole.

A manifest is written beside its place and moved there without overwriting, so of two
writers one fails and starts again from the newer version.  A job that loses executors or
dies leaves files that no manifest names; ``vacuum`` deletes those and files that only old
versions name.  Manifests hold a line of metadata for each file; no row reaches the driver.

Defined results: an empty arrival commits a version without a new file; rows, nulls and
repeated rows are kept as they come; the columns of the first arrival are the table's, and
later arrivals must have them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

TARGET_BYTES = 128 << 20
FAN_IN = 4
RATIO = 4


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int
    arrival: int


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


def tiers(shards: list[Shard]) -> list[list[Shard]]:
    """Shards of similar size together, from the smallest on."""
    out: list[list[Shard]] = []
    for s in sorted(shards, key=lambda s: (s.n_bytes, s.path)):
        if not out or s.n_bytes > RATIO * out[-1][0].n_bytes:
            out.append([])
        out[-1].append(s)
    return out


class Store:
    """A table of shards below ``root``."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The newest version; 0 before the first arrival."""
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return max((int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> int:
        """The one step that readers see: a move that fails where the version exists."""
        staged, final = f"{self.root}/manifests/.{uuid.uuid4().hex}", f"{self.root}/manifests/v{version:012d}.json"
        out = self._fs.create(self._path(staged), False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(staged).toUri() if "://" in staged else self._fs.getUri(), self._conf)
        never = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = never
        try:
            files.rename(self._path(staged), self._path(final), options)
        except Exception as e:
            self._fs.delete(self._path(staged), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, df: DataFrame, arrival: int) -> list[Shard]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        files = self._fs.listStatus(self._path(folder))
        return [Shard(f.getPath().toString(), f.getLen(), arrival) for f in files if f.getPath().getName().endswith(".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival; the new version."""
        now = self.manifest()
        schema = now["schema"] or rows.schema.json()
        if now["schema"]:
            rows = rows.select(*json_names(schema))
        new = self._written(rows, now["version"] + 1)
        return self._commit(now["version"] + 1, schema, [*now["shards"], *new])

    def compact(self) -> int:
        """Merges tiers that are due; the new version, or the old one if none is."""
        now = self.manifest()
        due = [t for t in tiers([s for s in now["shards"] if 2 * s.n_bytes < self.target_bytes]) if len(t) >= self.fan_in]
        if not due:
            return now["version"]
        merged = [s for t in due for s in t]
        left = [s for s in now["shards"] if s not in merged]
        n = max(1, round(sum(s.n_bytes for s in merged) / self.target_bytes))
        rows = self._rows(now["schema"], merged)
        new = self._written(rows.coalesce(n), max(s.arrival for s in merged))
        return self._commit(now["version"] + 1, now["schema"], [*left, *new])

    def _rows(self, schema: str, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(s.path for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        found = self.manifest(version)
        if not found["version"]:
            raise ValueError("nothing has arrived")
        return self._rows(found["schema"], found["shards"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that none of the last ``keep`` versions names; their number.

        Not while another writer is at work: its files have no manifest yet.
        """
        last = self.version()
        named = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        gone = 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/shards")):
            files = [f.getPath() for f in self._fs.listStatus(folder.getPath())]
            shards = [f for f in files if f.getName().endswith(".parquet")]
            dead = [f for f in shards if f.toString() not in named]
            if len(dead) == len(shards):
                self._fs.delete(folder.getPath(), True)
            else:
                for f in dead:
                    self._fs.delete(f, False)
            gone += len(dead)
        return gone


def json_names(schema: str) -> list[str]:
    return [f["name"] for f in json.loads(schema)["fields"]]
