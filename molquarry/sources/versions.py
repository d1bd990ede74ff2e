"""Versioned snapshots of tables: one folder for each version and a metadata table."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> str:
    """Order-insensitive checksum of all rows."""
    h = df.agg(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{h['h']}:{h['n']}".encode()).hexdigest()


def retained(meta: DataFrame, most: int) -> DataFrame:
    """Adds ``keep``: whether a version is among the newest ``most``, which are few and broadcast."""
    newest = meta.orderBy(F.desc("timestamp"), F.desc("id")).limit(most).select("id", F.lit(True).alias("keep"))
    return meta.join(F.broadcast(newest), "id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


class VersionStore:
    """save / load / verify / prune below one folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str, most: int = 10):
        self.root, self.most = root.rstrip("/"), most
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def metadata(self) -> dict:
        p = self._path(f"{self.root}/metadata.json")
        if not self._fs.exists(p):
            return {"versions": [], "current_version": None, "last_update": None}
        s = self._fs.open(p)
        try:
            return json.loads(self._io.toString(s, "UTF-8"))
        finally:
            s.close()

    def _put(self, meta: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/metadata.json"), True)
        try:
            out.write(bytearray(json.dumps(meta, indent=1).encode()))
        finally:
            out.close()

    def save(self, df: DataFrame, tag: str = "", version: str | None = None) -> str:
        """Write a version; saving one of the same name again replaces it. Older ones are pruned."""
        now = datetime.datetime.now(datetime.timezone.utc)
        name = version or "_".join(x for x in (f"v_{now:%Y%m%d_%H%M%S}", hashlib.md5(now.isoformat().encode()).hexdigest()[:8], tag) if x)
        path = f"{self.root}/version={name}"
        df.write.mode("overwrite").parquet(path)
        back = df.sparkSession.read.parquet(path)
        size = self._fs.getContentSummary(self._path(path)).getLength()
        meta = self.metadata()
        meta["versions"] = [v for v in meta["versions"] if v["id"] != name] + [{"id": name, "timestamp": now.isoformat(), "tag": tag, "size": size, "checksum": checksum(back)}]
        meta["current_version"], meta["last_update"] = name, now.isoformat()
        for v in meta["versions"][: -self.most]:
            self._fs.delete(self._path(f"{self.root}/version={v['id']}"), True)
        meta["versions"] = meta["versions"][-self.most :]
        self._put(meta)
        return name

    def load(self, spark: SparkSession, version: str | None = None, before: str | None = None) -> DataFrame | None:
        """A version's table, the current one by default; None if there is none. ``before``: newest of a smaller name."""
        meta = self.metadata()
        if before is not None:
            names = sorted(v["id"] for v in meta["versions"] if v["id"] < before)
            version = names[-1] if names else None
            if version is None:
                return None
        version = version or meta["current_version"]
        if version is None or not any(v["id"] == version for v in meta["versions"]):
            return None
        return spark.read.parquet(f"{self.root}/version={version}")

    def verify(self, spark: SparkSession, version: str) -> bool:
        """Whether the checksum still holds; True for unknown versions and ones without a checksum."""
        known = next((v for v in self.metadata()["versions"] if v["id"] == version), None)
        return not known or not known["checksum"] or checksum(self.load(spark, version)) == known["checksum"]
