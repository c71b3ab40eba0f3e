"""The whole pipelines: raw sheets to the re-scored report, raw member export to
the clean member list.  Each is one lazy plan but for what its stages checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions import dates as D
from clientele.functions import text as X
from clientele.operators import clean as C
from clientele.operators import dedup as U
from clientele.operators import pricing as P
from clientele.operators import report as R
from clientele.session import checkpoint_once
from clientele.sources import schemas as S


@dataclass(frozen=True)
class SalesChain:
    """The tables of the sales pipeline."""
    priced: DataFrame
    report: DataFrame
    rescored: DataFrame


#: Distinct texts of a column up to which what they mean is broadcast (some 60 bytes each).
BROADCAST_TEXTS = 200_000


def distinct_texts(t: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct texts of each column and how many rows have them (column, text, n), in one scan, checkpointed."""
    cells = (t.select(*[F.col(c).cast("string").alias(c) for c in columns]).groupingSets([[c] for c in columns], *columns)
             .agg(*[F.grouping(c).alias(f"no_{c}") for c in columns], F.count(F.lit(1)).alias("n")))
    column = F.coalesce(*[F.when(F.col(f"no_{c}") == 0, F.lit(c)) for c in columns])
    return checkpoint_once(cells.select(column.alias("column"), F.coalesce(*columns).alias("text"), "n"))


def priced_sales(raw: DataFrame, pricelist: DataFrame, years=X.LABEL_YEARS, month_first: bool | None = None,
                 limit: int = BROADCAST_TEXTS) -> DataFrame:
    """Raw sheets (headers as exported, and ``row_id``) to priced transactions:
    rows with a label only go, month labels are expanded, NaN is null, dates are
    read by their shape (in the order that the column votes for, unless
    ``month_first`` says it), prices are looked up.  All of that is patterns, many a
    text: each distinct label, date and item is read once and joined.  A column of
    more than ``limit`` distinct texts is read row by row."""
    t = S.conform(raw, S.TRANSACTION_COLUMN_MAP | {"row_id": "row_id"})
    t = C.drop_label_only_rows(S.nan_to_null(t), "month", keep=("row_id",))
    texts = distinct_texts(t, ["month", "tx_date", "item"])
    few = {r["column"]: r["n"] <= limit for r in texts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda column: texts.where(F.col("column") == column)
    if month_first is None:
        month_first = D.is_month_first(of("tx_date"), "text", "n")
    for column, read in (("month", lambda c: X.clean_month_label(c, years)),
                         ("tx_date", lambda c: D.parse_any_date(c, month_first=month_first))):
        if few.get(column):
            table = of(column).select("text", read("text").alias("_read"))
            t = t.join(F.broadcast(table), F.col(column).cast("string").eqNullSafe(F.col("text")), "left").withColumn(
                column, F.col("_read")).drop("text", "_read")
        else:
            t = t.withColumn(column, read(column))
    if "qty" in t.columns:
        t = t.withColumn("qty", F.col("qty").cast("string").try_cast("decimal(18,2)"))
    return P.price_lookup(t.drop("total_price"), pricelist, items=of("item").select("text") if few.get("item") else None)


def sales_chain(raw: DataFrame, pricelist: DataFrame, members: DataFrame, **options) -> SalesChain:
    """Raw sheets -> priced transactions -> summary report -> rule re-score."""
    priced = priced_sales(raw, pricelist, **options)
    report = R.rfm_report(priced, members)
    return SalesChain(priced, report, R.rescore_rules(report).select(*R.REPORT_COLUMNS))


def member_chain(raw: DataFrame, lookup: DataFrame, line: str = "line_no", skin: str = "skin_type",
                 yes_no: list[str] | None = None) -> DataFrame:
    """Raw two-line export (``line`` numbers it) to one row per person: lines are
    paired, names split, rows without address or valid district go, records of one
    person are merged, and those with a skin type stay."""
    pairs = C.pair_rows(raw, line).withColumn("no", F.col("no").cast("string").try_cast("long"))
    with_address, _ = C.split_by_address(C.split_name(pairs))
    placed = C.valid_districts(C.enrich_district(with_address, lookup))
    merged = U.merge_persons(U.resolve_persons(placed, row_id=line), row_id=line, yes_no=yes_no)
    return C.with_value(merged, skin)
