"""Months and month ranges read from text, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Month names in seven languages, full and short, in the order of the year.
MONTHS = """
january jan jänner januar janvier janv enero ene janeiro gennaio январь января янв
february feb februar février févr febrero fevereiro fev febbraio февраль февраля фев
march mar märz mrz mars marzo março март марта мар
april apr avril avr abril abr aprile апрель апреля апр
may mai mayo maio maggio май мая
june jun juni juin junio junho giugno июнь июня июн
july jul juli juillet juil julio julho luglio июль июля июл
august aug août aou agosto ago август августа авг
september sep sept septembre septiembre setembro set settembre сентябрь сентября сен сент
october oct oktober okt octobre octubre outubro out ottobre октябрь октября окт
november nov novembre noviembre novembro ноябрь ноября ноя нояб
december dec dezember dez décembre déc diciembre dic dezembro dicembre декабрь декабря дек
"""
MONTH_OF = {name: k for k, line in enumerate(MONTHS.strip().splitlines(), 1) for name in line.split()}

# Words for a range that still runs.
CURRENT = "till now|to date|нв|текущее время|a ce jour|bis heute|la actualidad|oggi|attuale|present|current|now|today|ongoing|heute|derzeit|aktuell|jetzt|aujourd'hui|aujourd’hui|présent|en cours|actuel|actualidad|presente|actualmente|hoy|atual|atualmente|o momento|hoje|настоящее время|по настоящее время|сейчас|наст. время|по сей день|н.в.".split("|")

_NAMES = "|".join(sorted(MONTH_OF, key=lambda m: (-len(m), m)))
YEAR = r"(19[5-9]\d|20\d\d|2100)"


def _number(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def parse_year_month(c: Column) -> Column:
    """struct(year, month, format) of an endpoint: YYYY-MM, MM/YYYY, Month YYYY, YYYY Month or YYYY (month null); null where none is told."""
    low = F.lower(F.trim(c))
    months = F.create_map(*[x for name, k in MONTH_OF.items() for x in (F.lit(name), F.lit(k))])
    take = lambda p, g: F.regexp_extract(low, p, g)
    iso, numeric = rf"^{YEAR}[-./](0[1-9]|1[0-2]|[1-9])$", rf"^(0[1-9]|1[0-2]|[1-9])[-./]{YEAR}$"
    named, reverse = rf"^({_NAMES})\.?,?\s+(?:de\s+)?{YEAR}$", rf"^{YEAR},?\s+({_NAMES})\.?$"
    made = lambda y, m, f: F.struct(_number(y).alias("year"), m.alias("month"), F.lit(f).alias("format"))
    return (
        F.when(low.rlike(iso), made(take(iso, 1), _number(take(iso, 2)), "iso"))
        .when(low.rlike(numeric), made(take(numeric, 2), _number(take(numeric, 1)), "numeric-month-year"))
        .when(low.rlike(named), made(take(named, 2), F.try_element_at(months, take(named, 1)), "month-name-year"))
        .when(low.rlike(reverse), made(take(reverse, 1), F.try_element_at(months, take(reverse, 2)), "month-name-year"))
        .when(low.rlike(f"^{YEAR}$"), made(take(f"^{YEAR}$", 1), F.lit(None).cast("int"), "year-only"))
    )


def clean_token(c: Column) -> Column:
    """Lower case without accents, no-break spaces plain, marks at the end off."""
    return F.trim(F.regexp_replace(T.normalize(c), r"[.,;\s]+$", ""))


def is_current_marker(c: Column) -> Column:
    """A word for now, dots or not, with at most two characters after it."""
    token = clean_token(c)
    bare = F.replace(token, F.lit("."), F.lit(""))
    marks = sorted({_fold(m) for m in CURRENT})
    near = lambda x, m: F.startswith(x, m) & (F.length(x) <= F.length(m) + 2)
    told = F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: near(token, m) | near(bare, F.replace(m, F.lit("."), F.lit(""))))
    return F.coalesce(told, F.lit(False))


def _fold(marker: str) -> str:
    table = dict(zip(map(ord, T._accent_table()[0]), T._accent_table()[1]))
    return marker.translate(table).replace("’", "'").lower()


SEPARATOR = r"\s*(?:[‐-―−~]|--|(?<=\s)-|-(?=\s)|-(?=(?:\d{4}(?!\d)|\p{L})))\s*(?:по\s+)?|\s+(?:to|bis|à|au|a|até|до|по)\s+(?:по\s+)?"


def parse_date_range(c: Column) -> Column:
    """struct(start, end, is_current): a range, an open range, or one endpoint as both ends; a word for now alone is current without ends; null where neither is told."""
    parts = F.filter(F.split(F.trim(c), SEPARATOR, 2), lambda x: F.trim(x) != "")
    left, right = F.get(parts, 0), F.get(parts, 1)
    start, end = parse_year_month(left), parse_year_month(right)
    current = is_current_marker(right)
    told = F.struct(start.alias("start"), F.when(right.isNull(), start).when(~current, end).alias("end"), current.alias("is_current"))
    none = F.lit(None).cast("struct<year:int,month:int,format:string>")
    alone = F.struct(none.alias("start"), none.alias("end"), F.lit(True).alias("is_current"))
    whole = parse_year_month(c)
    single = F.struct(whole.alias("start"), whole.alias("end"), F.lit(False).alias("is_current"))
    return F.when(whole.isNotNull(), single).when(start.isNotNull(), told).when(is_current_marker(c), alone)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + F.coalesce(month, F.lit(1)) - 1


def range_months(start: Column, end: Column) -> Column:
    """Months of an inclusive range of month indexes; never negative."""
    return F.greatest(end - start + 1, F.lit(0))


def format_months(n: Column) -> Column:
    years, months = F.floor(n / 12), n % 12
    part = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u)))
    return F.when(n == 0, "0 mo").otherwise(F.concat_ws(" ", part(years, " y"), part(months, " mo")))


def format_year_month(year: Column, month: Column) -> Column:
    return F.when(month.isNull(), year.cast("string")).otherwise(F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("/"), year.cast("string")))
