"""Declared schemas and schema conforming.

All of this is driver-side work on ``df.schema`` (names and types only);
it decides which ``select`` the executors run and never touches data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The reference's member-export header -> our column names.
MEMBER_COLUMN_MAP = {
    "No.": "no", "Code": "code", "Name": "name", "VIP": "vip", "detail": "detail",
    "Birthplace": "birthplace", "BirthDate": "birthdate_str", "Address": "address",
    "JenisKulit": "jeniskulit", "FitzPatrick": "fitzpatrick", "Category": "category",
    "DiscountType": "discounttype", "Province": "province", "City": "city", "Country": "country",
    "PostalCode": "postalcode", "Hp": "hp", "Fax": "fax", "Email": "email",
    "Profession": "profession", "Hobby": "hobby", "Delivery": "delivery", "DineIn": "dinein",
    "Deposit": "deposit", "ewar": "reward", "Points": "points", "Receiv": "received",
    "Officer": "officer", "Check": "check", "Status": "status", "District": "district",
}
# Transaction sheet headers -> our column names.
TRANSACTION_COLUMN_MAP = {
    "Month": "month", "Date": "tx_date", "NAMA CUSTOMER": "customer",
    "NAMA TREATMENT": "item", "QTY": "qty", "NO. TF": "ticket", "Total_Price": "total_price",
}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def conform(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Strip header names, keep only mapped columns that exist, rename
    (names holding dots such as ``No.`` are quoted)."""
    stripped = {c.strip(): c for c in df.columns}
    cols = [F.col(_q(stripped[k])).alias(v) for k, v in mapping.items() if k in stripped]
    return df.select(*cols)


def fill_missing(df: DataFrame, defaults: dict[str, tuple[object, str]]) -> DataFrame:
    """Add absent columns as typed literals: ``{col: (value, type)}``."""
    out = df
    for c, (v, t) in defaults.items():
        if c not in df.columns:
            out = out.withColumn(c, F.lit(v).cast(t))
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating-point column as null: a sheet's empty number is no value."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(_q(c)), F.col(_q(c))).alias(c) if c in floating else F.col(_q(c)) for c in df.columns])


def resolve_column(df: DataFrame, preferred: str, aliases=(), fuzzy=(), numeric_fallback=False):
    """The column to use for a logical field: the preferred name, an
    alias, the first name containing every ``fuzzy`` token, or (optionally)
    the first numeric column; None when nothing fits."""
    cols = df.columns
    if preferred in cols:
        return preferred
    for a in aliases:
        if a in cols:
            return a
    if fuzzy:
        for c in cols:
            if all(t in c.lower() for t in fuzzy):
                return c
    if numeric_fallback and cols and isinstance(df.schema[cols[0]].dataType, NumericType):
        return cols[0]
    return None


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Q4: raise a clear error naming every missing required column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def all_null_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q4: one aggregate row flagging columns that hold no value at all."""
    return df.agg(*[(F.count(_q(c)) == 0).alias(f"{c}_all_null") for c in cols])


def insert_after(df: DataFrame, anchor: str, new_cols: list[str]) -> DataFrame:
    """Reorder so ``new_cols`` follow ``anchor`` (others keep their order)."""
    cols = [c for c in df.columns if c not in new_cols]
    i = cols.index(anchor) + 1
    return df.select(*[_q(c) for c in cols[:i] + new_cols + cols[i:]])
