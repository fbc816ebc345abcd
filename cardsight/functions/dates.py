"""Date and time parsing.

Formats are chosen once per column by a vote (one aggregation pass over
the data, a few counters returned to the driver), then applied as one
column expression. Two-digit years follow the 69..99 -> 19xx rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsight.constants import DOB_FORMATS, FORMAT_STOP_SHARE, TS_FORMATS, TWO_DIGIT_YEAR_PIVOT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_c(col).cast("string"), r"\s+", " "))


def _two_digit_year(fmt: str) -> bool:
    stripped = fmt.replace("yyyy", "")
    return "yy" in stripped


def shape_regex(fmt: str) -> str:
    """A regular expression every text accepted by ``fmt`` must match:
    ``M d H h`` are 1-2 digits, doubled letters 2 digits, ``yy`` exactly 2,
    ``yyyy`` 4 or more, ``a`` two letters; other characters are literal.
    Used as a cheap guard so the parser only sees plausible texts (a failed
    parse is far costlier than a regex test); it never rejects a text the
    format accepts."""
    import re
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        run = j - i
        if ch == "y":
            out.append(r"\d{2}" if run == 2 else r"\d{4,}")
        elif ch in "MdHhms":
            out.append(r"\d{1,2}" if run == 1 else r"\d{%d}" % run)
        elif ch == "a":
            out.append("[A-Za-z]{2}")
        else:
            out.append(re.escape(ch) * run)
        i = j
    out.append("$")
    return "".join(out)


def parse_with(col, fmt: str) -> Column:
    """Text -> TIMESTAMP_NTZ with one format, null when it does not
    parse. For a two-digit-year format, years past the pivot move back a
    century (so ``1/1/90`` is 1990 and ``1/1/55`` stays 2055)."""
    text = _c(col)
    ts = F.when(text.rlike(shape_regex(fmt)),
                F.try_to_timestamp(text, F.lit(fmt))).cast("timestamp_ntz")
    if _two_digit_year(fmt):
        ts = F.when(F.year(ts) > F.lit(TWO_DIGIT_YEAR_PIVOT),
                    F.timestamp_add("YEAR", F.lit(-100), ts)).otherwise(ts)
    return ts


_FULL_DATE = r"^\d{4}-\d{2}-\d{2}([ T].+)?$"


def parse_service_time(col) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` first, else another ISO-8601 form with a
    whole date; null when neither parses."""
    text = _c(col).cast("string")
    return F.when(text.rlike(_FULL_DATE), F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), text.try_cast("timestamp_ntz")))


def parse_feature_time(col) -> Column:
    """The feature builder's fallback when no listed format fits: a time with an
    offset is moved to UTC."""
    text = _c(col).cast("string")
    has_offset = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & text.rlike(_FULL_DATE)
    return F.when(has_offset, F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")) \
        .otherwise(text.try_cast("timestamp_ntz"))


@dataclass
class FormatVote:
    column: str
    chosen: str | None          # None: fall back to the generic parser
    failures: dict[str, int]    # per tried format, rows that did not parse
    rows: int

    @property
    def fallback(self) -> bool:
        return self.chosen is None


def vote_formats(df: DataFrame, spec: dict[str, list[str]],
                 stop_share: float = FORMAT_STOP_SHARE, extra_aggs: dict | None = None) -> dict[str, FormatVote]:
    """A17 for several columns in one aggregation pass: count unparsed rows
    for every candidate format of every column, then pick per column the first
    format with at most ``stop_share`` failures, else the one with the fewest
    (the first of these). When it fails on every row the generic parser is used. ``extra_aggs`` (name -> aggregate column) ride
    along in the same pass; their values are returned under ``"_extra"``."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [agg.alias(f"_x_{name}") for name, agg in (extra_aggs or {}).items()]
    # The white space is collapsed once per column, behind its own projection.
    df = df.withColumns({f"_v{j}": collapse_ws(column) for j, column in enumerate(spec)})
    for j, (column, formats) in enumerate(spec.items()):
        raw = F.col(f"_v{j}")
        aggs += [F.count_if(parse_with(raw, f).isNull()).alias(f"_c{j}_f{i}") for i, f in enumerate(formats)]
    row = df.agg(*aggs).first()
    rows = int(row["_rows"])
    votes = {}
    for j, (column, formats) in enumerate(spec.items()):
        failures = {f: int(row[f"_c{j}_f{i}"]) for i, f in enumerate(formats)}
        within = [f for f in formats if failures[f] <= stop_share * rows]
        best = within[0] if within else min(formats, key=failures.__getitem__)
        if failures[best] == rows:
            best = None
        votes[column] = FormatVote(column, best, failures, rows)
    if extra_aggs:
        votes["_extra"] = {name: row[f"_x_{name}"] for name in extra_aggs}
    return votes


def vote_format(df: DataFrame, column: str, formats=TS_FORMATS,
                stop_share: float = FORMAT_STOP_SHARE) -> FormatVote:
    """A17 for one column (see ``vote_formats``)."""
    return vote_formats(df, {column: list(formats)}, stop_share)[column]


def parse_column(df: DataFrame, column: str, formats=TS_FORMATS, mode: str = "column",
                 out: str | None = None, vote: FormatVote | None = None) -> DataFrame:
    """Parse a text time column.

    ``mode="column"``: one format for the whole column (chosen by
    ``vote_format``); rows written another way become null.
    ``mode="row"``: the first format that parses each row.
    """
    raw = collapse_ws(column)
    target = out or column
    if mode == "row":
        return df.withColumn(target, F.coalesce(*[parse_with(raw, f) for f in formats]))
    if mode != "column":
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn(target, parsed_text(column, vote or vote_format(df, column, formats)))


def parsed_text(column: str, vote: FormatVote) -> Column:
    """A text column's time under a vote's format, null where it does not parse."""
    raw = collapse_ws(column)
    return parse_feature_time(raw) if vote.fallback else parse_with(raw, vote.chosen)


def time_columns(df: DataFrame) -> dict[str, list[str]]:
    """The raw text time columns present and their candidate formats."""
    spec = {}
    if "trans_date_trans_time" in df.columns and dict(df.dtypes)["trans_date_trans_time"] == "string":
        spec["trans_date_trans_time"] = list(TS_FORMATS)
    if "dob" in df.columns and dict(df.dtypes)["dob"] == "string":
        spec["dob"] = list(DOB_FORMATS)
    return spec


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once per row, whatever reads them.

    A plain projection would be merged with the ones above it, and a filter on
    a parsed column pushed below it, so that the parse runs again in both. A
    one-element ``inline`` keeps its place."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_times(df: DataFrame, mode: str = "column", votes: dict[str, FormatVote] | None = None) -> DataFrame:
    """X2 + X3 on a raw feed: ``trans_date_trans_time`` and ``dob`` text.
    In column mode both formats are voted in one pass unless ``votes`` are
    given (e.g. from a fit on the same feed). White space is collapsed and each
    text parsed once per row."""
    spec = time_columns(df)
    if not spec:
        return df
    if mode not in ("column", "row"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "column" and votes is None:
        votes = vote_formats(df, spec)

    def parsed(column: str, raw: Column) -> Column:
        if mode == "row":
            return F.coalesce(*[parse_with(raw, f) for f in spec[column]])
        vote = votes[column]
        return parse_feature_time(raw) if vote.fallback else parse_with(raw, vote.chosen)

    out = computed_once(df, {f"_text_{c}": collapse_ws(c) for c in spec})
    out = computed_once(out, {f"_time_{c}": parsed(c, F.col(f"_text_{c}")) for c in spec})
    return out.select(*[F.col(f"_time_{c}").alias(c) if c in spec else F.col(c) for c in df.columns])


def whole_days(later, earlier) -> Column:
    """Whole 24-hour days between two times (floor, also when negative)."""
    secs = F.unix_timestamp(_c(later).cast("timestamp")) - F.unix_timestamp(_c(earlier).cast("timestamp"))
    return F.floor(secs / F.lit(86400))


def age_years(ts, dob) -> Column:
    """Whole days from birth to the transaction, floor-divided by 365."""
    return F.floor(whole_days(ts, dob) / F.lit(365))


def hour_of(ts) -> Column:
    """Hour of day."""
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(_c(ts))


def month_of(ts) -> Column:
    """Month number."""
    return F.month(_c(ts))


def seconds_of_day(col) -> Column:
    """An ``HH:MM:SS`` text or a timestamp -> seconds since midnight."""
    c = _c(col)
    ts = F.coalesce(F.try_to_timestamp(c.cast("string"), F.lit("H:m:s")), c.try_cast("timestamp"))
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
