"""Member and transaction cleaning stages (F1, F7, F8, K4, W13, X9-X11,
X14-X16, X28, J13, P4, P9, P10, X6-X8).

Every stage is a narrow DataFrame transformation or a key-to-key join;
nothing walks rows on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions import dates as D
from clientele.functions import text as X

NOT_FOUND = "Not Found"
# Fixed value: the geocoder component type that names a district.
DISTRICT_COMPONENT = "administrative_area_level_3"
GEOCODE_REPLY_SCHEMA = ("status STRING, results ARRAY<STRUCT<address_components: "
                        "ARRAY<STRUCT<long_name: STRING, types: ARRAY<STRING>>>>>")


# ------------------------------------------------------------ transactions
def drop_label_only_rows(df: DataFrame, label: str = "Month", keep: tuple[str, ...] = ()) -> DataFrame:
    """drop rows where only the label column is filled (and those of ``keep``, such as a row id)."""
    others = [c for c in df.columns if c != label and c not in keep]
    if not others:
        return df
    only_label = F.col(label).isNotNull() & reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in others])
    return df.where(~only_label)


def clean_transactions(df: DataFrame, label: str = "Month", years=X.LABEL_YEARS) -> DataFrame:
    """The transaction cleaning stage: F1, month label X4+X5, dates X19."""
    out = drop_label_only_rows(df, label)
    out = out.withColumn(label, X.clean_month_label(label, years))
    return D.dates_only(out)


# ------------------------------------------------------------ members
def pair_rows(raw: DataFrame, line_col: str = "line_no", first_col: str = "no",
              birthplace: str = "birthplace", address: str = "address",
              birth_date: str = "birth_date") -> DataFrame:
    """W13 (+X10, X14): lines 2k and 2k+1 of the raw export form one member.

    The bottom line's birthplace overrides when present; a bottom first cell
    ``*address ...`` appends the text after its first ':' to the address
    (C9: without a ':' it adds nothing).  A trailing odd line stands alone.
    The pairing is one ``groupBy`` on ``line // 2``: the export is read once, and
    no row order leaves Spark.
    """
    line = F.col(line_col)
    own = F.struct(*[D.normalize_dmy(c).alias(c) if c == birth_date else F.col(c) for c in raw.columns])
    rest = F.struct(F.col(birthplace).alias("bp"), F.col(first_col).alias("first"))
    pairs = (raw.groupBy(F.floor(line / 2).alias("_pair"))
             .agg(F.first(F.when(line % 2 == 0, own), ignorenulls=True).alias("_top"),
                  F.first(F.when(line % 2 == 1, rest), ignorenulls=True).alias("_bot"))
             .where(F.col("_top").isNotNull()))
    j = pairs.select("_top.*", F.col("_bot.bp").alias("_bp"), F.col("_bot.first").alias("_first"))
    extra = F.when(X.is_address_continuation("_first"), X.continuation_text("_first"))
    addr = F.col(address)
    new_addr = (F.when(extra.isNull(), addr)
                 .when(addr.isNull() | (addr == ""), extra)
                 .otherwise(F.concat(addr, F.lit(", "), extra)))
    return (j.withColumn(birthplace, F.coalesce("_bp", F.col(birthplace)))
             .withColumn(address, new_addr)
             .drop("_bp", "_first"))


def split_name(df: DataFrame, name: str = "name") -> DataFrame:
    """X6-X8 + X15 + P4: VIP level and bracket notes out of the name, name
    stripped of brackets; ``vip`` and ``detail`` placed right after ``name``."""
    out = (df.withColumn("vip", X.vip_level(name))
             .withColumn("detail", X.bracket_details(name))
             .withColumn(name, X.strip_brackets(name)))
    if "birth_date" in df.columns:
        out = out.withColumn("birth_date", D.reformat_dmy("birth_date"))
    cols = [c for c in df.columns if c not in ("vip", "detail")]
    i = cols.index(name) + 1
    return out.select(*cols[:i], "vip", "detail", *cols[i:])


def has_text(c: str):
    """F7 predicate: not null and not blank after stripping."""
    return F.coalesce(X.strip_ws(F.col(c).cast("string")) != "", F.lit(False))


def split_by_address(df: DataFrame, address: str = "address") -> tuple[DataFrame, DataFrame]:
    """K4: (with address, without address); the address is stripped, null -> ''."""
    a = df.withColumn(address, X.strip_ws(F.coalesce(F.col(address), F.lit(""))))
    return a.where(F.col(address) != ""), a.where(F.col(address) == "")


def enrich_district(df: DataFrame, lookup: DataFrame, address: str = "address") -> DataFrame:
    """District by a left join on the normalised address; a miss is
    'Not Found', a blank address gets null.  Replaces one web request per
    row with one join (the lookup table is deduplicated on its key first)."""
    lk = (lookup.select(X.name_key("address").alias("_ak"), F.col("district").alias("_district"))
                .groupBy("_ak").agg(F.min("_district").alias("_district")))
    blank = ~has_text(address)
    j = df.withColumn("_ak", X.name_key(address)).join(lk, "_ak", "left")
    return (j.withColumn("district", F.when(blank, F.lit(None).cast("string"))
                                      .otherwise(F.coalesce("_district", F.lit(NOT_FOUND))))
             .drop("_ak", "_district"))


def district_from_reply(reply_col: str = "reply"):
    """The 'administrative_area_level_3' name of the first result of a
    stored geocoder reply; 'Not Found' when the status is not OK or the
    component is missing."""
    r = F.from_json(F.col(reply_col), GEOCODE_REPLY_SCHEMA)
    comps = F.get(r["results"], 0)["address_components"]
    hit = F.filter(comps, lambda c: F.array_contains(c["types"], DISTRICT_COMPONENT))
    name = F.get(hit, 0)["long_name"]
    return F.when(r["status"] == "OK", F.coalesce(name, F.lit(NOT_FOUND))).otherwise(F.lit(NOT_FOUND))


def valid_districts(df: DataFrame, district: str = "district", prefix: str = "Kecamatan") -> DataFrame:
    """F8 + X9: drop 'Not Found' (null kept), strip the administrative prefix."""
    return (df.where(~F.col(district).eqNullSafe(NOT_FOUND))
              .withColumn(district, X.strip_admin_prefix(district, prefix)))


def with_value(df: DataFrame, col: str) -> DataFrame:
    """Rows whose column holds text; an empty result keeps the schema."""
    return df.where(has_text(col))


def canonical_profile(df: DataFrame, text_cols: list[str], yes_no_cols: list[str],
                      numeric_cols: list[str] = ()) -> DataFrame:
    """P9 + P10 + P7: unknown text -> 'Unknown', yes/no canonical, numeric
    text -> number or null (``try_cast``)."""
    out = df
    for c in text_cols:
        out = out.withColumn(c, X.canonical_unknown(c))
    for c in yes_no_cols:
        out = out.withColumn(c, X.canonical_yes_no(c))
    for c in numeric_cols:
        out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    return out


def with_age(df: DataFrame, birth_text: str, as_of: str) -> DataFrame:
    """X16 + X18: birth date with year repair and whole-year age at ``as_of``."""
    b = D.parse_birth_date(birth_text)
    return df.withColumn("birth_date", b).withColumn("age", D.age_years(F.col("birth_date"), as_of))
