"""Date parsing and calendar helpers as native Column expressions.

Two-digit years are never parsed with Spark's ``yy`` (which always means
20yy); the century is chosen by an explicit pivot instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientele.functions.text import strip_ws

# The century pivots used by the reference.
BIRTHDATE_TEXT_PIVOT = 30      # normalize_dmy: yy > 30 -> 19yy, else 20yy
BIRTHDATE_PARSE_PIVOT = 30     # parse_date:   yy < 30 -> 20yy, else 19yy


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _zfill2(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def century(yy: Column, pivot: int, pivot_goes_old: bool) -> Column:
    """Four-digit year from a two-digit one.

    ``pivot_goes_old=True``: yy > pivot -> 19yy else 20yy (text normaliser);
    ``False``: yy < pivot -> 20yy else 19yy (birth-date parser).
    """
    y = yy.try_cast("int")
    if pivot_goes_old:
        return F.when(y > pivot, y + 1900).otherwise(y + 2000)
    return F.when(y < pivot, y + 2000).otherwise(y + 1900)


def normalize_dmy(c, pivot: int = BIRTHDATE_TEXT_PIVOT) -> Column:
    """Birth-date text -> 'DD-MM-YYYY' (zero padded); not 3 parts -> ''."""
    s = strip_ws(_col(c).cast("string"))
    parts = F.split(s, "[-/]")
    d, m, y = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    y2 = F.when((F.length(y) == 2) & y.rlike(r"^\d+$"),
                century(y, pivot, True).cast("string")).otherwise(y)
    out = F.concat_ws("-", _zfill2(d), _zfill2(m), y2)
    return F.when(s.isNull(), F.lit("")).when(F.size(parts) == 3, out).otherwise(F.lit(""))


def reformat_dmy(c) -> Column:
    """Strict day-first reformat to 'dd-MM-yyyy'; unparseable -> null."""
    return F.date_format(F.try_to_date(_col(c), "d-M-yyyy"), "dd-MM-yyyy")


def parse_birth_date(c, pivot: int = BIRTHDATE_PARSE_PIVOT) -> Column:
    """X16: 'd-m-y' with year repair -> DATE (null when invalid).

    2-digit year: < pivot -> 20yy else 19yy.  3-digit: '1ab' -> 19ab,
    '2ab'/'0ab' -> 20ab, else invalid; a '1..' result before 1950 gains 90.
    """
    s = _col(c).cast("string")
    parts = F.split(s, "-")
    d = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    yp = F.get(parts, 2)
    suffix = F.substring(yp, 2, 2).try_cast("int")
    three = (F.when(F.substring(yp, 1, 1) == "1", suffix + 1900)
              .when(F.substring(yp, 1, 1).isin("2", "0"), suffix + 2000))
    three = F.when((three < 1950) & yp.startswith("1"), three + 90).otherwise(three)
    year = (F.when(F.length(yp) == 2, century(yp.try_cast("int").cast("string"), pivot, False))
             .when(F.length(yp) == 3, three)
             .when(F.length(yp) == 4, yp.try_cast("int")))
    text = F.format_string("%04d-%02d-%02d", year, m, d)
    ok = (F.size(parts) == 3) & year.isNotNull() & d.isNotNull() & m.isNotNull() & (year > 0)
    return F.when(ok, F.try_to_date(text, "yyyy-MM-dd"))


# English month names, by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAME = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         "|nov(?:ember)?|dec(?:ember)?)")
# A time of day may follow; only the date as it is written counts.
_TIME = r"(?:[t ]\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:am|pm)?\s*(?:z|[+-]\d{2}:?\d{2})?)?$"
_SEP = r"[ /.,-]+"
#: Shapes of a date in lower case: step, pattern, and where it holds year, month and day.  Behind the
#: last two, numbers only, the text does not tell which of the first two is the day.
SHAPES = [
    ("iso", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, "$1|$2|$3"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})" + _TIME, "$1|$2|$3"),
    ("month_name", r"^(\d{1,2})" + _SEP + _NAME + _SEP + r"(\d{4}|\d{2})" + _TIME, "$3|$2|$1"),
    ("month_name", "^" + _NAME + _SEP + r"(\d{1,2})" + _SEP + r"(\d{4})" + _TIME, "$3|$1|$2"),
    ("month_name", r"^(\d{4})" + _SEP + _NAME + _SEP + r"(\d{1,2})" + _TIME, "$1|$2|$3"),
    ("day_first", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _TIME, "$3|$2|$1"),
    ("two_digit_year", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})" + _TIME, "$3|$2|$1"),
]
_TRIPLES = ["day_first", "two_digit_year"]


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """DATE from numeric parts; an impossible calendar date gives null."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y.try_cast("int") > 0) & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _by_shape(c, use) -> Column:
    """``use(step, year, month, day)`` of a text's shape, evaluated once for each
    text; without a shape all four are null.  The parts are texts."""
    s = F.lower(strip_ws(_col(c).cast("string")))
    parts = F.lit(None).cast("string")
    for step, pattern, order in reversed(SHAPES):
        parts = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, f"{step}|{order}")).otherwise(parts)
    return F.get(F.transform(F.array(F.split(parts, r"\|")), lambda p: use(*(F.get(p, i) for i in range(4)))), 0)


def parse_date_steps(c, pivot: int = BIRTHDATE_PARSE_PIVOT, month_first: bool = False) -> Column:
    """X17 + Q1: struct(date, step) - which rule parsed each value.

    Each text has one of the ``SHAPES`` at most; a time of day behind the date
    is dropped.  A triple of numbers with the year last is read day first (C16),
    or month first where ``month_first`` says so, and the other way round only
    if that is no date: the step names the order used, or 'two_digit_year' for
    a short year, which goes through the century pivot.
    """
    def read(step, year, month, day):
        year = F.when(F.length(year) == 2, century(year, pivot, False).cast("string")).otherwise(year)
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(month, 1, 3)).cast("string")
        month = F.when(month.rlike("^[a-z]"), number).otherwise(month)
        triple = step.isin(_TRIPLES)
        usual, turned = _ymd(year, month, day), F.when(triple, _ymd(year, day, month))
        first, second = (F.when(triple, turned).otherwise(usual), usual) if month_first else (usual, turned)
        names = ("month_first", "day_first") if month_first else ("day_first", "month_first")
        named = lambda order: F.when(step == "day_first", F.lit(order)).otherwise(step)
        return F.struct(F.coalesce(first, second).alias("date"),
                        F.when(first.isNotNull(), named(names[0])).when(second.isNotNull(), named(names[1]))
                        .otherwise(F.lit("failed")).alias("step"))

    return _by_shape(c, read)


def parse_any_date(c, pivot: int = BIRTHDATE_PARSE_PIVOT, month_first: bool = False) -> Column:
    """Multi-format text date -> DATE, null when nothing matches."""
    return parse_date_steps(c, pivot, month_first).getField("date")


def day_month_votes(df, c, weight: str | None = None):
    """How many triples of numbers of a column can only be read day first
    and how many only month first; one aggregate row (n_day_first, n_month_first).
    A row counts ``weight`` times."""
    def vote(step, year, second, first):
        first, second = F.when(step.isin(_TRIPLES), first).cast("int"), second.try_cast("int")
        return (F.when((first > 12) & second.between(1, 12), "d").when((second > 12) & first.between(1, 12), "m"))

    voted = df.select(_by_shape(c, vote).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    votes = lambda v: F.coalesce(F.sum(F.when(F.col("v") == v, F.col("n"))), F.lit(0))
    return voted.agg(votes("d").alias("n_day_first"), votes("m").alias("n_month_first"))


def is_month_first(df, c, weight: str | None = None) -> bool:
    """The order of a column's triples, by majority; day first if the votes are equal."""
    votes = day_month_votes(df, c, weight).first()
    return votes["n_month_first"] > votes["n_day_first"]


def age_years(birth, as_of) -> Column:
    """Whole years as ``days // 365`` at ``as_of`` (a parameter, not now())."""
    return F.floor(F.datediff(_col(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("date"),
                              _col(birth)) / 365).cast("long")


def dates_only(df):
    """Every timestamp column cut to its date."""
    from pyspark.sql.types import TimestampNTZType, TimestampType
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            cols.append(F.to_date(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def day_shift(c, days: int) -> Column:
    """Midnight truncation plus a day shift."""
    return F.date_add(F.to_date(_col(c)), days)


def month_key(c) -> Column:
    """X21: 'yyyy-MM' period label."""
    return F.date_format(_col(c), "yyyy-MM")


def month_display(c) -> Column:
    """X21: 'Mon yyyy' label (e.g. 'Jan 2024')."""
    return F.date_format(_col(c), "MMM yyyy")
