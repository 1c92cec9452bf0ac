"""Several Parquet tables that change together, behind one commit marker.

Every change writes new folders and then one numbered marker file that lists
the folders of all tables.  The marker is put in place by a rename that fails
if its number is taken, so of two writers that started from one version one
fails and the tables are as the other left them.  A failure before the marker
leaves the old version; the folders it wrote are listed nowhere.  On a store
whose rename isn't atomic writers must not run at the same time.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Markers that stay; older ones aren't read any more.
KEPT_MARKERS = 20


class ConcurrentCommit(RuntimeError):
    """Someone else committed the version that follows."""


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, from spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/checkpoints"  # one machine, as in tests
    return base.rstrip("/") + "/lucidex-tables"


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _markers(self) -> list[int]:
        fs, folder = self._file("_commits")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def state(self) -> dict:
        """Version, tables and notes of the highest marker; version 0 without any."""
        numbers = self._markers()
        if not numbers:
            return {"version": 0, "tables": {}, "notes": {}}
        fs, path = self._file(f"_commits/{numbers[-1]:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table of a version (the newest if none is given); None where it has none."""
        entry = (state or self.state())["tables"].get(name)
        if entry is None:
            return None
        schema = T.StructType.fromJson(entry["schema"])
        reader = self.spark.read.schema(schema)
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        # Folders may be partitioned alike: each has its own base.
        parts = [reader.option("basePath", f).parquet(f) for f in entry["folders"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, name: str, df: DataFrame, by: tuple[str, ...] = (), after: dict | None = None) -> dict:
        """Write df into a new folder; the entry for commit(), which also lists the folders of after where rows are added."""
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(folder) if by else df.write.parquet(folder)
        return {"folders": [*(after or {}).get("folders", []), folder], "schema": df.schema.jsonValue()}

    def commit(self, state: dict, entries: dict[str, dict], notes: dict | None = None) -> dict:
        """Put the entries in place of those of state, all at once."""
        new = {"version": state["version"] + 1, "tables": state["tables"] | entries, "notes": state["notes"] | (notes or {})}
        fs, draft = self._file(f"_commits/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(new).encode())
        stream.close()
        context = self.spark.sparkContext
        jvm = context._jvm
        _, marker = self._file(f"_commits/{new['version']:010d}.json")
        try:
            none = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, marker, none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(marker):
                raise ConcurrentCommit(f"version {new['version']} of {self.path} is there already") from e
            raise
        for old in self._markers()[:-KEPT_MARKERS]:
            fs.delete(self._file(f"_commits/{old:010d}.json")[1], False)
        return new
