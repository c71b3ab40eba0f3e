"""Rule scores, the segment table and score ordering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW = "High", "Medium", "Low"

# The 27-row R x F x M -> segment table, in natural order.
SEGMENT_TABLE = [
    ("High", "High", "High", "Champion"),
    ("High", "High", "Medium", "Loyal"),
    ("High", "High", "Low", "Loyal"),
    ("High", "Medium", "High", "Loyal"),
    ("High", "Medium", "Medium", "Potential loyal"),
    ("High", "Medium", "Low", "Promising"),
    ("High", "Low", "High", "Recent Customers"),
    ("High", "Low", "Medium", "Recent Customers"),
    ("High", "Low", "Low", "Recent Customers"),
    ("Medium", "High", "High", "At risk"),
    ("Medium", "High", "Medium", "Need attention"),
    ("Medium", "High", "Low", "About to sleep"),
    ("Medium", "Medium", "High", "Need attention"),
    ("Medium", "Medium", "Medium", "About to sleep"),
    ("Medium", "Medium", "Low", "About to sleep"),
    ("Medium", "Low", "High", "Need attention"),
    ("Medium", "Low", "Medium", "About to sleep"),
    ("Medium", "Low", "Low", "About to sleep"),
    ("Low", "High", "High", "Cant lose them"),
    ("Low", "High", "Medium", "Cant lose them"),
    ("Low", "High", "Low", "Hibernating"),
    ("Low", "Medium", "High", "Cant lose them"),
    ("Low", "Medium", "Medium", "Hibernating"),
    ("Low", "Medium", "Low", "Hibernating"),
    ("Low", "Low", "High", "Cant lose them"),
    ("Low", "Low", "Medium", "Hibernating"),
    ("Low", "Low", "Low", "Lost"),
]
UNDEFINED = "Undefined"
# Score order used by the movement classes.
SCORE_ORDER = {"Low": 1, "Medium": 2, "High": 3}


@dataclass(frozen=True)
class RuleCutoffs:
    """C17 cut-offs (reference defaults).  R: < r_high High, <= r_medium Medium.
    F on item count: > f_high High, >= f_medium Medium.  M: > m_high High,
    >= m_medium Medium.  Everything else, null included, is Low."""
    r_high: int = 90
    r_medium: int = 180
    f_high: int = 13
    f_medium: int = 2
    m_high: float = 5_000_000
    m_medium: float = 1_000_000


DEFAULT_CUTOFFS = RuleCutoffs()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r_rule(c, k: RuleCutoffs = DEFAULT_CUTOFFS) -> Column:
    x = _col(c)
    return F.when(x < k.r_high, HIGH).when(x <= k.r_medium, MEDIUM).otherwise(LOW)


def f_rule(c, k: RuleCutoffs = DEFAULT_CUTOFFS) -> Column:
    x = _col(c)
    return F.when(x > k.f_high, HIGH).when(x >= k.f_medium, MEDIUM).otherwise(LOW)


def m_rule(c, k: RuleCutoffs = DEFAULT_CUTOFFS) -> Column:
    x = _col(c)
    return F.when(F.isnan(x.cast("double")), LOW).when(x > F.lit(k.m_high), HIGH).when(x >= F.lit(k.m_medium), MEDIUM).otherwise(LOW)


def _segment_map() -> Column:
    kv = []
    for r, f, m, seg in SEGMENT_TABLE:
        kv += [F.lit(f"{r}|{f}|{m}"), F.lit(seg)]
    return F.create_map(*kv)


def segment(r, f, m, missing: str | None = UNDEFINED) -> Column:
    """Segment name for three score labels; a miss gives ``missing``.

    The 27-row table is a literal map, so the lookup is an expression, not a join.
    """
    key = F.concat_ws("|", _col(r), _col(f), _col(m))
    hit = F.try_element_at(_segment_map(), key)
    return hit if missing is None else F.coalesce(hit, F.lit(missing))


def score_rank(c) -> Column:
    """Low=1, Medium=2, High=3, anything else null."""
    x = _col(c)
    out = None
    for k, v in SCORE_ORDER.items():
        out = (F.when(x == k, v) if out is None else out.when(x == k, v))
    return out


def segment_table_df(spark):
    """The segment table as a DataFrame (27 rows, safe to broadcast)."""
    return spark.createDataFrame(SEGMENT_TABLE, "R string, F string, M string, Classification string")
