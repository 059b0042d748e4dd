"""Parquet tables in the folder that driver and executors share, and a history that takes each key's rows once."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: jobs that follow read it instead of computing it again, and outlive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class History:
    """A table at ``path`` to which each key's rows are added once, whatever is tried again.

    Rows are written as a part of their own first; a manifest that names the part is then moved into place under the
    key. The move is the commit: it is one rename, and it fails where the key has a manifest already. Readers see the
    parts that manifests name, so that a part of a lost or repeated attempt is never seen.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, place: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}" if place else self.path)

    def _manifest(self, key: str) -> str:
        if not re.fullmatch(r"[\w.=-]{1,200}", key):
            raise ValueError(f"not a key: {key!r}")
        return f"manifests/{key}.json"

    def add(self, key: str, rows: DataFrame) -> bool:
        """Whether ``rows`` were added: False where ``key`` has its rows already, which then stay as they are."""
        manifest = self._manifest(key)
        if self._fs.exists(self._at(manifest)):
            return False
        part = f"parts/{key}-{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.parquet(f"{self.path}/{part}")
        draft = f"drafts/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._at(draft), True)
        out.write(json.dumps({"key": key, "part": part}, sort_keys=True).encode())
        out.close()
        self._fs.mkdirs(self._at("manifests"))
        if not self._fs.exists(self._at(manifest)) and self._fs.rename(self._at(draft), self._at(manifest)):
            return True
        self._fs.delete(self._at(draft), False)
        self._fs.delete(self._at(part), True)
        return False

    def keys(self) -> list[str]:
        return sorted(self._committed())

    def _committed(self) -> dict[str, str]:
        if not self._fs.exists(self._at("manifests")):
            return {}
        read = self.spark.read.schema("key string, part string").json(f"{self.path}/manifests")
        return {r["key"]: r["part"] for r in read.collect()}  # a row for each batch that was added

    def read(self) -> DataFrame:
        """The rows of all keys."""
        parts = [f"{self.path}/{p}" for p in self._committed().values()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def pending(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose column ``key`` the history has nothing of: what a resumed run still has to do."""
        return rows.join(self.read().select(key).distinct(), key, "left_anti")
