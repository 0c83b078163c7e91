"""A store of datasets: parquet tables with a profile beside them, in a folder that Spark can write."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetNotFoundError

_ID = re.compile(r"[0-9a-f]{12}")


class DatasetStore:
    """`<root>/data/<id>` holds the table, `<root>/catalog/<id>` its catalog row. Spark's committer makes each write whole or absent."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, part: str, dataset_id: str) -> str:
        if not _ID.fullmatch(dataset_id):
            raise DatasetNotFoundError(f"There is no dataset {dataset_id!r}.")
        return f"{self.root}/{part}/{dataset_id}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, filename: str, profile: dict[str, Any] | None = None, dataset_id: str | None = None) -> str:
        dataset_id = dataset_id or uuid.uuid4().hex[:12]
        df.write.mode("overwrite").parquet(self._path("data", dataset_id))
        row = (dataset_id, filename, datetime.now(UTC).isoformat(), json.dumps(profile or {}, ensure_ascii=False), df.schema.json())
        self.spark.createDataFrame([row], "dataset_id string, filename string, created_at string, profile string, schema string").coalesce(1).write.mode("overwrite").json(self._path("catalog", dataset_id))
        return dataset_id

    def get(self, dataset_id: str) -> dict[str, Any]:
        at, fs = self._fs(self._path("catalog", dataset_id))
        if not fs.exists(at):
            raise DatasetNotFoundError(f"There is no dataset {dataset_id!r}.")
        found = self.spark.read.schema("dataset_id string, filename string, created_at string, profile string, schema string").json(self._path("catalog", dataset_id)).first()
        return found.asDict() | {"profile": json.loads(found.profile)}

    def load(self, dataset_id: str) -> DataFrame:
        """The table, with the kinds that its columns were saved with."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.get(dataset_id)["schema"]))
        return self.spark.read.schema(schema).parquet(self._path("data", dataset_id))

    def list(self) -> DataFrame:
        """dataset_id, filename, created_at, newest first."""
        at, fs = self._fs(f"{self.root}/catalog")
        schema = "dataset_id string, filename string, created_at string"
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{self.root}/catalog").orderBy(F.desc("created_at"), "dataset_id")

    def delete(self, dataset_id: str) -> None:
        self.get(dataset_id)
        for part in ("catalog", "data"):
            at, fs = self._fs(self._path(part, dataset_id))
            fs.delete(at, True)
