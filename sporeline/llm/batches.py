"""Batches of rows committed once each under a folder that all executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Batches:
    """Rows of one schema, kept as committed batches.

    A writer puts a batch's rows into a folder of its own, writes a small file
    that names the folder, and gives that file the batch's mark as its name,
    with the order not to overwrite. The file system gives the mark to one
    writer, whole, so of two writers of a batch one wins, and what a writer
    that failed or lost has left is never read. Marks are one small file a
    batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _mark(self, batch: str):
        return self._path("marks", "mark-" + hashlib.sha256(batch.encode()).hexdigest())

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch once; False where it was there before, and then ``rows`` are not computed."""
        mark = self._mark(batch)
        if self.fs.exists(mark):
            return False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/rows/{name}")
        draft = self._path("drafts", name)
        file = self.fs.create(draft, False)
        file.write(bytearray(name.encode()))
        file.close()
        self.fs.mkdirs(mark.getParent())
        try:
            self._publish(draft, mark)
        except Exception:
            if not self.fs.exists(mark):
                raise
            self.fs.delete(self._path("rows", name), True)
            return False
        finally:
            self.fs.delete(draft, False)
        return True

    def _publish(self, draft, mark) -> None:
        """Give the draft the mark's name, unless that is taken: a link on a local disk, whose rename would overwrite, else a rename."""
        jvm = self.spark._jvm
        if self.fs.getScheme() == "file":
            disk = lambda path: jvm.java.io.File(path.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(disk(mark), disk(draft))
        elif not self.fs.rename(draft, mark):
            raise FileExistsError(str(mark))

    def read(self) -> DataFrame:
        """Rows of all committed batches; an empty table before the first."""
        if not self.fs.exists(self._path("marks")):
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)])
        marked = [r["value"] for r in self.spark.read.text(f"{self.folder}/marks").collect()]  # one line a batch
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/rows/{name}" for name in marked])
