"""Small control files through the cluster's own file systems, so any store that Spark reaches will do."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def write_text(self, name: str, text: str) -> None:
        """Written beside, then renamed: readers see all of it or nothing."""
        p, fs = self._at(name)
        tmp, _ = self._at(f"_tmp/{name.replace('/', '-')}")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        fs.mkdirs(p.getParent())
        fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise OSError(f"cannot write {p}")

    def read_text(self, name: str) -> str:
        p, fs = self._at(name)
        src = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src)).decode("utf-8")
        finally:
            src.close()

    def list(self, name: str) -> list[str]:
        p, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def rename(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        q, _ = self._at(new)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {p} to {q}")

    def delete(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def write_json(self, name: str, doc) -> None:
        self.write_text(name, json.dumps(doc))

    def read_json(self, name: str):
        return json.loads(self.read_text(name))


def scratch_root(spark: SparkSession, what: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``; on a local session without
    one, under a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brooklet-")
    return f"{found}/{what}-{uuid.uuid4().hex}"
