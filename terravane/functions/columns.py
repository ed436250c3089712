"""Column rules of the platform: classes, addresses, urls, distances, masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the five classes in their order, and the upper bounds of the first four
CLASSES = ("正常", "关注", "次级", "可疑", "损失")
UPPER = (0.60, 0.75, 0.85, 1.00)
WARN, RED, LOW_CONFIDENCE, ABNORMAL = 0.75, 0.85, 75.0, 0.30


def classify(ltv: Column) -> Column:
    """Class of a loan-to-value ratio; an unknown or negative one is substandard."""
    out = F.when(ltv.isNull() | (ltv < 0), CLASSES[2])
    for bound, name in zip(UPPER, CLASSES, strict=False):
        out = out.when(ltv <= bound, name)
    return out.otherwise(CLASSES[-1])


def class_rank(col: Column) -> Column:
    """0 to 4 in the order of severity; 5 for anything else."""
    at = F.array_position(F.array(*map(F.lit, CLASSES)), F.coalesce(col, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(F.lit(5)).cast("int")


def money(col: Column) -> Column:
    """Sum of amounts, exact to the cent whatever the order of rows."""
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def rounded(col: Column, digits: int) -> Column:
    """A double rounded as SQL databases do it, by scaling; ``round`` takes the decimal text, which differs where scaling meets a half."""
    return F.round(col * F.lit(10.0**digits)) / F.lit(10.0**digits)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio; null without a denominator."""
    return F.round(F.try_divide(part, F.nullif(whole, F.lit(0.0))), digits)


def number(text: Column, zero_is_null: bool = False) -> Column:
    """A number from text; null for blanks, words, NaN and infinities."""
    value = F.trim(text).try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return F.nullif(value, F.lit(0.0)) if zero_is_null else value


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def url_key(url: Column) -> Column:
    """A stable key for a listing's url: portal and id, or the md5 of the whole url."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rules = (
        ("zu.anjuke.com", r"g?fangyuan/(\d+)", "rent:zu:"),
        ("anjuke.com", r"prop/view/([A-Za-z0-9]+)", "sale:anjuke:"),
        ("58.com", r"xinfang/huxing/([\w-]+)", "sale:58:"),
    )
    portal, found = F.lit(""), None
    for name, pattern, prefix in rules:
        held = host.contains(name) & (portal == "")
        key = F.regexp_extract(path, pattern, 1)
        value = F.when(held & (key != ""), F.concat(F.lit(prefix), key))
        found = value if found is None else F.coalesce(found, value)
        portal = F.when(held, F.lit(name)).otherwise(portal)
    return F.coalesce(found, F.concat(F.lit("md5:"), F.md5(F.coalesce(url, F.lit("")).cast("binary"))))


_HAN = "[一-龥]"
_ADMIN = "(?:区|县|市|街道|镇)"


def city_in(address: Column, cities: dict[str, str], prefix: bool = False) -> Column:
    """Code of the first city whose name the address holds (or starts with)."""
    return F.coalesce(*[F.when(address.startswith(n) if prefix else address.contains(n), F.lit(c)) for n, c in cities.items()])


def city_label(address: Column) -> Column:
    """What stands before and with the first 市, unless that is all of it."""
    at = F.instr(address, "市")
    return F.when(at > 1, F.substring(address, F.lit(1), at))


def _after_city(address: Column) -> Column:
    return F.regexp_replace(address, f"^{_HAN}{{2,4}}市", "")


def _synthetic(address: Column) -> Column:
    return address.isNull() | (address == "") | address.startswith("合成地址")


def district(address: Column) -> Column:
    """Name of the district without its suffix, unless one letter would be left."""
    token = F.regexp_extract(_after_city(address), f"^({_HAN}{{1,6}}?{_ADMIN})", 1)
    bare = F.regexp_replace(token, f"{_ADMIN}$", "")
    return F.when(~_synthetic(address) & (token != ""), F.when(F.length(bare) >= 2, bare).otherwise(token))


def community(address: Column) -> Column:
    """The leading Han letters after the district and one more suffix."""
    body = _after_city(address)
    token = F.regexp_extract(body, f"^({_HAN}{{1,6}}?{_ADMIN})", 1)
    rest = F.when(token != "", F.regexp_replace(F.substring(body, F.length(token) + 1, F.length(body)), f"^{_ADMIN}", "")).otherwise(body)
    return F.when(~_synthetic(address), F.nullif(F.regexp_extract(rest, f"^({_HAN}+)", 1), F.lit("")))


def floor_level(text: Column) -> Column:
    return F.when(text.startswith("低层"), 0.0).when(text.startswith("中层"), 1.0).when(text.startswith("高层"), 2.0)


def floor_total(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "共([0-9]+)层", 1), F.lit("")).cast("double")


def mask(col: Column) -> Column:
    """Personal data but for its last four characters."""
    text = col.cast("string")
    return F.when(F.length(text) <= 4, "c****").otherwise(F.concat(F.lit("c****"), F.right(text, F.lit(4))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371.0088) -> Column:
    half = [F.pow(F.sin(F.radians(b - a) / 2), F.lit(2)) for a, b in ((lat1, lat2), (lng1, lng2))]
    return F.lit(2 * radius) * F.asin(F.sqrt(half[0] + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half[1]))


#: Kilometres for a degree, around the province's middle.
KM_LAT, KM_LNG = 110.57, 111.32 * math.cos(math.radians(23.5))


def east_km(lng: Column) -> Column:
    return (lng - F.lit(113.5)) * F.lit(KM_LNG)


def north_km(lat: Column) -> Column:
    return (lat - F.lit(23.5)) * F.lit(KM_LAT)


def gcj_to_wgs(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Latitude and longitude without the offset of Chinese map services (public datum formula)."""
    major, ee = 6378245.0, 0.00669342162296594323
    x, y = lng - F.lit(105.0), lat - F.lit(35.0)

    def waves(v: Column, *terms: tuple[float, float]) -> Column:
        return sum((F.lit(a) * F.sin(v * F.lit(math.pi * w)) for a, w in terms), F.lit(0.0)) * F.lit(2.0 / 3.0)

    common = waves(x, (20.0, 6.0), (20.0, 2.0))
    d_lat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common
    d_lat = d_lat + waves(y, (20.0, 1.0), (40.0, 1.0 / 3.0)) + waves(y, (160.0, 1.0 / 12.0), (320.0, 1.0 / 30.0))
    d_lng = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common
    d_lng = d_lng + waves(x, (20.0, 1.0), (40.0, 1.0 / 3.0)) + waves(x, (150.0, 1.0 / 12.0), (300.0, 1.0 / 30.0))
    rad = F.radians(lat)
    curve = 1 - F.lit(ee) * F.sin(rad) * F.sin(rad)
    outside = ~(lng.between(72.004, 137.8347) & lat.between(0.8293, 55.8271))
    fixed_lat = lat - d_lat * 180.0 / (F.lit(major * (1 - ee)) / (curve * F.sqrt(curve)) * F.lit(math.pi))
    fixed_lng = lng - d_lng * 180.0 / (F.lit(major) / F.sqrt(curve) * F.cos(rad) * F.lit(math.pi))
    return F.when(outside, lat).otherwise(fixed_lat), F.when(outside, lng).otherwise(fixed_lng)
