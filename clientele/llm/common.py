"""Helpers shared by the operators: tables, written intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.session import ensure_checkpoint_dir

#: White space of the text contracts, as a regular expression (fixed value).
SPACES = r"[\x20\x09-\x0D]+"
#: Words of the text contracts: maximal runs of anything else (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: rows hold whole texts or sets, so the default of 10,000 would be large.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a task's memory does not follow the number of rows."""
    if not 0 < int(spark.conf.get(_BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut, the plan runs once, later readers prune columns,
    and a lost executor costs only a re-read of files."""
    bound_batches(df.sparkSession)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_text(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_order(column: str | Column = "doc_id") -> Column:
    """A struct that orders ids with null last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(c.isNull().alias("missing"), c.alias("id"))
