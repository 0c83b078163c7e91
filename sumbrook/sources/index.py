"""Upkeep of a chunk index: documents are upserted by the hash of their content, and readers see the old index or the new one.

Documents are dealt over buckets by a hash of their id. A change writes the buckets that it touches anew, under a generation of its own, and only then a
manifest that says which generation of each bucket counts. A job that ends before that leaves the index as it was, and the next one does the work again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError

BUCKETS = 64


class ChunkIndex:
    """The index in a folder that all executors see. `chunked` makes of documents (document_id, text) their chunks, with document_id and any other columns."""

    def __init__(self, spark: SparkSession, path: str, chunked: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.chunked = spark, path.rstrip("/"), chunked
        self._jvm = spark._jvm
        self._files = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._manifest().get("buckets", buckets)

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- the manifest: which generation of each bucket counts; at most an entry a bucket

    def _manifests(self) -> list[str]:
        found = self._files.globStatus(self._place("manifest-*.json"))
        return sorted(f.getPath().getName() for f in found) if found else []

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {}
        stream = self._files.open(self._place(names[-1]))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, before: dict, generations: dict[str, str]) -> None:
        version = before.get("version", 0) + 1
        made = {"version": version, "buckets": self.buckets, "generations": generations}
        name, draft = f"manifest-{version:012d}.json", f"draft-{uuid.uuid4().hex}"
        stream = self._files.create(self._place(draft))
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        if self._files.exists(self._place(name)) or not self._files.rename(self._place(draft), self._place(name)):
            self._files.delete(self._place(draft), False)
            raise StoreError(f"Another job changed {self.path} meanwhile; do it again.")

    # --- reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _table(self, kind: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        wanted = [f"{self.path}/{kind}/{g}/bucket={b}" for b, g in manifest.get("generations", {}).items() if buckets is None or int(b) in buckets]
        there = [p for p in wanted if self._files.exists(self._jvm.org.apache.hadoop.fs.Path(p))]  # a bucket may have become empty
        return self.spark.read.parquet(*there) if there else None

    def documents(self) -> DataFrame:
        """document_id, content_hash of every document."""
        found = self._table("documents", self._manifest())
        return found if found is not None else self.spark.createDataFrame([], "document_id string, content_hash string")

    def chunks(self) -> DataFrame | None:
        """The chunks of every document; None of an index without any."""
        return self._table("chunks", self._manifest())

    # --- changing

    def upsert(self, documents: DataFrame) -> int:
        """Indexes the documents (document_id, text) that are new or have other content, and returns how many; if none are, nothing is written.

        Ids are texts, unique and not null; a null text has no content but is a document. Only the buckets of changed documents are rewritten.
        """
        given = documents.select(F.col("document_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text")).where("document_id is not null")
        marks = given.select("document_id", F.sha2("text", 256).alias("content_hash"))
        manifest = self._manifest()
        known = self._table("documents", manifest)
        fresh = marks if known is None else marks.join(known, ["document_id", "content_hash"], "left_anti")
        return self._rewritten(manifest, given, fresh)

    def delete(self, document_ids: DataFrame) -> int:
        """Takes documents (document_id) out of the index and returns how many were there; only their buckets are rewritten."""
        manifest = self._manifest()
        known = self._table("documents", manifest)
        if known is None:
            return 0
        gone = known.join(document_ids.select(F.col("document_id").cast("string").alias("document_id")), "document_id", "left_semi")
        return self._rewritten(manifest, None, gone)

    def _rewritten(self, manifest: dict, given: DataFrame | None, marks: DataFrame) -> int:
        """Writes the buckets of the marked documents without their old chunks and, where texts are given, with their new ones."""
        touched = {r.bucket: r.n for r in marks.groupBy(self._bucket().alias("bucket")).agg(F.count("*").alias("n")).collect()}  # a row for each bucket
        if not touched:
            return 0
        generation = uuid.uuid4().hex
        made = {"documents": None, "chunks": None} if given is None else {"documents": marks, "chunks": self.chunked(given.join(marks.select("document_id"), "document_id", "left_semi"))}
        for kind, new in made.items():
            old = self._table(kind, manifest, set(touched))
            kept = None if old is None else old.join(marks.select("document_id"), "document_id", "left_anti")
            rows = kept if new is None else new if kept is None else kept.unionByName(new, allowMissingColumns=True)
            if rows is not None:
                rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{generation}")
        self._commit(manifest, manifest.get("generations", {}) | {str(b): generation for b in touched})
        return sum(touched.values())

    def clean(self) -> list[str]:
        """Deletes what no reader of the last manifest sees: drafts, older manifests and generations, and returns their names. Not for use while a job writes."""
        names, used = self._manifests(), set(self._manifest().get("generations", {}).values())
        gone = names[:-1] + [f.getPath().getName() for f in self._files.globStatus(self._place("draft-*"))]
        for kind in ("documents", "chunks"):
            gone += [f"{kind}/{f.getPath().getName()}" for f in self._files.globStatus(self._place(f"{kind}/*")) or [] if f.getPath().getName() not in used]
        for name in gone:
            self._files.delete(self._place(name), True)
        return gone
