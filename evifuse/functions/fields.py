"""Column expressions that clean raw text fields into typed values."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing".
MISSING_WORDS = ("", "nan", "none", "null", "nat", "<na>")

_TIME = r"(?: +(\d{1,2}:\d{1,2}(?::\d{1,2})?))?"
# Accepted timestamp shapes, each with the year-month-day text it stands
# for. Day comes before month; a rewritten text fits no later shape.
DAY_FIRST = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$", "$1-$2-$3 $4"),
    (rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}){_TIME}$", "$3-$2-$1 $4"),
    # Two-digit years 69-99 belong to the last century.
    (rf"^(\d{{1,2}})/(\d{{1,2}})/([0-5]\d|6[0-8]){_TIME}$", "20$3-$2-$1 $4"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(69|[7-9]\d){_TIME}$", "19$3-$2-$1 $4"),
    (r"^(\d{1,2})-(\d{1,2})-([0-5]\d|6[0-8])$", "20$3-$2-$1"),
    (r"^(\d{1,2})-(\d{1,2})-(69|[7-9]\d)$", "19$3-$2-$1"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
)
# Shapes read month-first when no day-first reading is a date.
MONTH_FIRST = (
    (rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}){_TIME}$", "$3-$1-$2 $4"),
    (rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{2}}){_TIME}$", "20$3-$1-$2 $4"),
)
# Month names as written in dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


# Layouts of other statements, tried in this order when none above fits; day before month.
RARE_LAYOUTS = [
    f"{day}{time}"
    for day in ("d-MMM-yyyy", "d-MMMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d.M.yyyy", "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "M-d-yyyy")
    for time in ("", " H:mm:ss", " H:mm", " h:mm:ss a", " h:mm a")
]


def layout_shape(layout: str) -> str:
    """A date layout with every number as 9 and every name as a, as the shape of a text shows them."""
    return re.sub("[dMyHhms]+", "9", re.sub("M{3,}|a", "#", layout)).replace("#", "a")


def present(c: Column) -> Column:
    """Trimmed text, or null when the text only says that a value is missing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*MISSING_WORDS), t)


def money(c: Column) -> Column:
    """Amount text to double; separators and currency signs dropped, junk is 0."""
    t = F.trim(F.regexp_replace(c.cast("string"), "[,$₹]", ""))
    return F.coalesce(F.when(t.rlike(_NUMBER), t.cast("double")), F.lit(0.0))


def moment(c: Column) -> Column:
    """Timestamp text in any accepted shape to timestamp_ntz; null when unreadable.

    The cleaned text is bound once (as the one element of an array); then a row costs
    one pattern test per shape up to its own, one rewrite and one cast.
    """

    def rewritten(x: Column, shapes) -> Column:
        out = F.lit(None).cast("string")
        for shape, text in reversed(shapes):
            out = F.when(x.rlike(shape), F.regexp_replace(x, shape, text)).otherwise(out)
        return F.trim(out).try_cast("timestamp")

    def named(x: Column) -> Column:
        y = F.lower(x)
        for n, month in enumerate(MONTHS, start=1):
            y = F.replace(y, F.lit(f"-{month}-"), F.lit(f"-{n}-"))
        return F.when(x.rlike(r"^\d{1,2}-[A-Za-z]{3}-(\d{4}|\d{2})$"), rewritten(y, DAY_FIRST))

    def read(x: Column) -> Column:
        return F.coalesce(rewritten(x, DAY_FIRST), named(x), rewritten(x, MONTH_FIRST), x.try_cast("timestamp"), rare(x))

    def rare(x: Column) -> Column:
        """Only the layouts of the text's own shape are tried, so junk costs one lookup."""
        shape = F.regexp_replace(F.regexp_replace(x, "[0-9]+", "9"), "[A-Za-z]+", "a")
        by_shape: dict[str, list[Column]] = {}
        for layout in RARE_LAYOUTS:
            by_shape.setdefault(layout_shape(layout), []).append(F.try_to_timestamp(x, F.lit(layout)))

        def read_as(key: Column) -> Column:
            out = F.lit(None).cast("timestamp")
            for name, parsers in by_shape.items():
                out = F.when(key == name, F.coalesce(*parsers)).otherwise(out)
            return out

        return F.transform(F.array(shape), read_as)[0]

    return F.transform(F.array(present(c)), read)[0].cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Timestamp as microseconds, the unit every temporal operator works in."""
    return F.unix_micros(c.cast("timestamp"))


def row_token(prefix: str, ref: Column) -> Column:
    """Evidence token that cites one source row."""
    return F.concat(F.lit(prefix), F.coalesce(ref.cast("string"), F.lit("N/A")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def institution(source_file: Column) -> Column:
    """Institution named by the source file."""
    f = F.lower(source_file)
    # File-name marker and institution, first match wins.
    marks = (
        ("sbi", "SBI Bank"),
        ("hdfc", "HDFC Bank"),
        ("icici", "ICICI Bank"),
        ("cdr", "Operator-CDR"),
        ("ipdr", "Operator-IPDR"),
        ("bank", "Bank (General)"),
    )
    out = F.when(f.contains(marks[0][0]), marks[0][1])
    for mark, name in marks[1:]:
        out = out.when(f.contains(mark), name)
    return out.otherwise("Other Institution")


def identifier_type(c: Column) -> Column:
    """Kind of a bare identifier."""
    return (
        F.when(c.rlike(r"^[6-9]\d{9}$"), "phone")
        .when(c.startswith("ACCT_") | c.rlike(r"(?i)^ACC[_\-]"), "account")
        .when(c.contains("@"), "vpa")
        .when(c.rlike(r"^3[5-9]\d{13}$"), "imei")
        .when(c.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(c.rlike(r"^\d{15}$"), "imei")
        .when(c.rlike(r"^\d{10,}$"), "phone")
        .otherwise("account")
    )


def narration_parts(c: Column) -> tuple[Column, Column, Column]:
    """(utr, counterparty, channel) read from a statement narration."""
    s = present(c)

    def found(pattern: str) -> Column:
        hit = F.regexp_extract(s, pattern, 1)
        return F.when(hit != "", hit)

    channel = F.upper(found(r"(?i)(UPI|IMPS|NEFT|RTGS)"))
    utr = found(r"(?:^|[/\-])([0-9]{12})(?:[/\-]|$)")
    vpa = found(r"([A-Za-z0-9._]+@[A-Za-z0-9]+)")
    fourth = F.trim(F.get(F.split(s, r"[/\-]"), F.lit(3)))
    # Words in fourth place that name no party.
    stop = ("Payment", "CREDIT", "DEBIT", "CR", "DR", "P2A", "P2M")
    named = F.when((fourth != "") & ~fourth.rlike(r"^[0-9]+$") & ~fourth.isin(*stop), fourth)
    return utr, F.coalesce(vpa, named), channel


def repeats_header(cells: Column, header: Column) -> Column:
    """True when a row of cells is the header drawn again."""
    same = F.zip_with(
        cells,
        header,
        lambda a, b: (F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(b)))
        & (F.trim(F.coalesce(a, F.lit(""))) != ""),
    )
    hits = F.size(F.filter(same, lambda x: x))
    need = F.greatest(F.lit(2), F.floor(F.size(header) / 2))
    return F.coalesce((F.size(cells) == F.size(header)) & (hits >= need), F.lit(False))
