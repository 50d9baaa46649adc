"""Row-local checks on a stream: stateless projections, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.rows import check_rows, is_row_local
from factloom.plans.model import Constraint, FactType


def stream_violations(rows: DataFrame, fact_type: FactType, constraints: list[Constraint]) -> DataFrame:
    """Violations of a streaming DataFrame of fact rows (pop_id, inst_id and one column per role).

    Rules that look at more than one row need state without bound and are refused.
    """
    wider = [c.id for c in constraints if not is_row_local(c, fact_type)]
    if wider:
        raise ValueError(f"not row-local: {', '.join(wider)}")
    return check_rows(rows, fact_type, constraints)


def write_violations(violations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append violations as Parquet; exactly once through the file sink's log."""
    return (
        violations.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
