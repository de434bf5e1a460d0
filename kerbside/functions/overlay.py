"""Position and bearing from the text that an overlay shows, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.geo import dms_decimal, valid_coords

# Rewrites of misread numbers, in order.
REWRITES = (
    (r"[\r\n]+", " "),
    (r"""[°º˚′″"\\]""", " "),
    (r"(?<=\d)[Oo](?=\d)", "0"),
    (r"(?<=\d)[Il](?=\d)", "1"),
    (r"\s*\|\s*", " / "),
    (r"([+-]?)(\d{2,3})/(\d{4,6})(?!\d)", "$1$2.$3"),
    (r"([+-])(\d{3})(\d{5})(?!\d)", "$1$2.$3"),
    (r"(\d{2,3}\.\d{3})\s+(\d{2,3})(?!\d)", "$1$2"),
    (r"(\d{2,3})[ ,](\d{4,5})(?!\d)", "$1.$2"),
    (r"(\.\d{4,6})([+-]\d{2,3}\.\d{4,6})", "$1 / $2"),
    (r"\s{2,}", " "),
)
# Coordinate formats, the first that gives a valid position wins.
FORMATS = (
    r"[Pp]osition[:\s]+([+-]?\d{2,3}\.\d+)\s*[/|\\]\s*([+-]\d{2,3}\.\d+)",
    r"[Pp]osition[:\s]+(\d{2,3}\.\d+)\s*[/|\\]\s*([+-]\d{2,3}\.\d+)",
    r"([+-]\d{2,3}\.\d{4,})\s*[/|\\]\s*([+-]\d{2,3}\.\d{4,})",
    r"(\d{2,3}\.\d{4,})\s*[/|\\]\s*([+-]\d{2,3}\.\d{4,})",
    r"(?i)lat[itude]*[:\s]+([+-]?\d{1,3}\.\d+)[,\s]+lon[gitude]*[:\s]+([+-]?\d{1,3}\.\d+)",
    r"(?i)(?:gps|location|coord(?:inates?)?)[:\s]+([+-]?\d{1,3}\.\d+)[,\s]+([+-]?\d{1,3}\.\d+)",
    r"([+-]\d{1,3}\.\d{4,})\s*[,/]\s*([+-]\d{1,3}\.\d{4,})",
)
DMS = r"(?i)([NS])\s*(\d{1,3})\s*(\d{1,2})\s*(\d{1,2}(?:\.\d+)?)\s*([EW])\s*(\d{1,3})\s*(\d{1,2})\s*(\d{1,2}(?:\.\d+)?)"
ANCHOR = r"(\d{2,3})[.,](\d{4,6})"
BEARING = r"(?i)(?:azimuth|bearing|heading)[^\d\-+]*([0-3]?\d{1,2}(?:\.\d+)?)"


def clean_number(text: Column) -> Column:
    for pattern, by in REWRITES:
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def _pair(lat: Column, lng: Column) -> Column:
    """A struct of a valid position, else null."""
    return F.when(valid_coords(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _west(p: Column) -> Column:
    lat, lng = p["a"], p["b"]
    return _pair(lat, F.when((lng > 0) & (lat > 0) & (lng > lat), -lng).otherwise(lng))


def format_coords(text: Column) -> Column:
    """Struct lat, lng by the first of the formats that fits; in the Americas' quadrant a longitude without sign is west."""
    found = []
    for p in FORMATS:
        pair = F.struct(_number(text, p, 1).alias("a"), _number(text, p, 2).alias("b"))
        found.append(F.when(text.rlike(p), _once(pair, _west)))
    part = lambda g: _number(text, DMS, g)
    lat = dms_decimal(part(2), part(3), part(4), F.regexp_extract(text, DMS, 1))
    lng = dms_decimal(part(6), part(7), part(8), F.regexp_extract(text, DMS, 5))
    dms = _once(F.struct(lat.alias("lat"), lng.alias("lng")), lambda c: _pair(c["lat"], c["lng"]))
    return F.coalesce(*found, F.when(text.rlike(DMS), dms))


def anchor_coords(cleaned: Column) -> Column:
    """Struct lat, lng by size: the first number of 20 to 50 is a latitude, the first other of 65 to 130 a west longitude."""
    whole = F.regexp_extract_all(cleaned, F.lit(ANCHOR), 1)
    digits = F.regexp_extract_all(cleaned, F.lit(ANCHOR), 2)
    v = F.zip_with(whole, digits, lambda a, b: F.concat(a, F.lit("."), F.substring(b, 1, 5)).cast("double"))
    lat = F.get(F.filter(v, lambda x: x.between(20, 50)), F.lit(0))
    lng = -F.get(F.filter(v, lambda x: x.between(65, 130)), F.lit(0))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def _once(value: Column, then) -> Column:
    """then(value), with value computed once a row however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_coords(text: Column) -> Column:
    """Position in a text: by format in the text as it is, then cleaned, then by size."""
    by_format = F.get(F.filter(F.transform(F.array(text, clean_number(text)), format_coords), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(by_format, _once(clean_number(text), anchor_coords))


def text_bearing(text: Column) -> Column:
    v = _number(text, BEARING, 1)
    return F.when(text.rlike(BEARING) & v.between(0, 360), F.pmod(v, F.lit(360.0)))


def region_cascade(bottom: Column, top: Column, full: Column) -> Column:
    """The first region's struct lat, lng, bearing, raw_text, region whose text holds a position; error texts count as none."""

    def found(r: Column) -> Column:
        text = r["text"]
        usable = (text != "") & ~text.startswith("API_ERROR") & ~text.startswith("EXCEPTION")
        raw = F.substring(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), 1, 500)

        def row(c: Column) -> Column:
            return F.when(c.isNotNull(), F.struct(F.round(c["lat"], 7).alias("lat"), F.round(c["lng"], 7).alias("lng"), F.round(text_bearing(text), 2).alias("bearing"), raw.alias("raw_text"), r["region"].alias("region"), F.lit("vision").alias("method")))

        return F.when(usable, _once(text_coords(text), row))

    regions = F.array(*(F.struct(F.lit(n).alias("region"), t.alias("text")) for n, t in (("bottom", bottom), ("top", top), ("full", full))))
    return F.get(F.filter(F.transform(regions, found), lambda x: x.isNotNull()), F.lit(0))
