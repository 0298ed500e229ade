"""Clusters kept up to date while an aligner still writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions.storage import discard, materialize
from sporeline.operators.forests import roots_of
from sporeline.operators.graph import connected_components


class ClusterLog:
    """Connected components of all edges so far, kept as a log under a folder that all executors reach.

    A batch adds rows (node, component) for its new nodes, with the component
    as it was then, and (old, new) for components that its edges have joined;
    nothing is written again. A batch counts once its mark is there, so one
    that was lost on the way is written anew and one that comes again changes
    nothing. Batches come one at a time, as a stream's do. A component is named
    by its least node.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string"):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *map(str, parts))))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Committed batches: one name a batch."""
        fs, marks = self._fs(), self._path("marks")
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(marks)) if fs.exists(marks) else []

    def _rows(self, table: str, columns: list[str]) -> DataFrame:
        schema = ", ".join(f"{c} {self.kind}" for c in columns)
        paths = [f"{self.folder}/{table}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        """(node, component) of all committed batches."""
        nodes, joined = self._rows("nodes", ["node", "component"]), self._rows("joined", ["old", "new"])
        ends = joined.select(F.col("old").alias("node"), F.col("new").alias("to"))
        tops = joined.select(F.col("new").alias("node")).join(joined.select(F.col("old").alias("node")), "node", "left_anti").distinct()
        roots = roots_of(ends.unionByName(tops.select("node", F.col("node").alias("to"))))
        now = roots.select(F.col("node").alias("component"), "root")
        return nodes.join(now, "component", "left").select("node", F.coalesce("root", "component").alias("component"))

    def add(self, edges: DataFrame, batch: int | str) -> bool:
        """Take in a batch of edges (src, dst); False where it was there before."""
        if str(batch) in self.batches():
            return False
        pairs = materialize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct())
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        homes = materialize(ends.join(self.members(), "node", "left").select("node", F.col("component").alias("known"), F.coalesce("component", "node").alias("home")))
        side = lambda c: homes.select(F.col("node").alias(c), F.col("home").alias(f"{c}_home"))
        links = pairs.join(side("u"), "u").join(side("v"), "v").select("u_home", "v_home")
        parts = materialize(connected_components(links, nodes=homes.select("home"), src="u_home", dst="v_home").select(F.col("node").alias("home"), "component"))
        new = homes.where("known IS NULL").join(parts, "home").select("node", "component")
        joined = homes.where("known IS NOT NULL").select("home").distinct().join(parts, "home").where("home <> component").select(F.col("home").alias("old"), F.col("component").alias("new"))
        new.write.mode("overwrite").parquet(f"{self.folder}/nodes/{batch}")
        joined.write.mode("overwrite").parquet(f"{self.folder}/joined/{batch}")
        self._fs().create(self._path("marks", batch), True).close()
        discard(pairs, homes, parts)
        return True


def stream_clusters(edges: DataFrame, log: ClusterLog, checkpoint: str, trigger: dict | None = None):
    """The started query that takes a stream of edges (src, dst) into ``log``, batch by batch.

    After each batch ``log.members()`` is the answer of ``connected_components``
    over all edges so far. A batch that Spark delivers again changes nothing.
    """
    writer = edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: log.add(batch, number) and None)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
