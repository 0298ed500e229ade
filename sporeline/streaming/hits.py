"""Best hits kept up to date while an aligner still writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.operators.hits import filter_hits


def stream_best_hits(hits_stream: DataFrame, conds: list[tuple[str, str, float]] = ()) -> DataFrame:
    """The best hit of each query so far, for update or complete mode: the answer of ``best_hit`` by score.

    State is one row a query; ties go to the smaller line_no.
    """
    kept = filter_hits(hits_stream, list(conds))
    best = F.max_by(F.struct(*hits_stream.columns), F.struct("score", -F.col("line_no")))
    return kept.groupBy("query_id").agg(best.alias("best")).select("query_id", *[F.col("best")[c].alias(c) for c in hits_stream.columns if c != "query_id"])
