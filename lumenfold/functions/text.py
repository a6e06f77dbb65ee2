"""Names, paths, numbers in file names, and JSON inside model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import COUNTRY_ALIASES, COUNTRY_NAMES, IMAGE_EXTENSIONS, NUMBERED_PREFIXES, TRAVEL_WORDS, VIDEO_EXTENSIONS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin(VIDEO_EXTENSIONS), "video").otherwise("other")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def safe_name(name: Column) -> Column:
    """File-system characters become underscores; dots and blanks at the ends go."""
    return F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(". "))


def sidecar_target(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.supplemental-metadata)?\.json$", "")


def sequence_number(name: Column) -> Column:
    """The number of a camera file: after a known prefix, or a name of digits alone."""
    s = F.upper(stem(name))
    prefixed = F.regexp_extract(s, f"(?:{'|'.join(NUMBERED_PREFIXES)})[-_]?(\\d{{4,8}})", 1)
    bare = F.regexp_extract(s, r"^(\d{4,10})$", 1)
    return F.coalesce(F.nullif(prefixed, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("bigint")


def numeric_prefix(text: Column) -> Column:
    """A leading integer, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def is_travel(name: Column) -> Column:
    return name.rlike(r"(?i)\b(" + "|".join(TRAVEL_WORDS) + r")\b")


def album_name_reply(text: Column) -> Column:
    """A model's album name without quotes, stars and runs of blanks; null unless 4 to 79 long."""
    clean = F.btrim(F.regexp_replace(F.replace(F.btrim(text, F.lit(" \n\t\"'")), F.lit("*")), r"\s+", " "))
    return F.when(F.length(clean).between(4, 79), clean)


def hashtags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), F.ltrim(t, F.lit("#")))), " ")


def location_label(city: Column, country: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.lit(""))


def country_name(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)


def country_code(name: Column) -> Column:
    codes = {v.upper(): k for k, v in COUNTRY_NAMES.items()} | COUNTRY_ALIASES
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.try_element_at(table, F.upper(name))


def json_greedy(text: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_lazy(text: Column) -> Column:
    """From the first brace to the next closing one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*?\}", 0), F.lit(""))


def json_balanced(text: Column) -> Column:
    """The first run with as many closing as opening braces, code fences removed; braces inside strings count, too.

    A running sum over the braces, kept in the JVM: depth 0 is first reached again at the end of the run.
    """
    body = F.regexp_replace(text, r"```(?:json)?", "")
    start = F.instr(body, "{")
    rest = F.substring(body, start, F.length(body))
    step = lambda acc, c: F.struct(
        (acc["n"] + F.when(acc["done"], 0).otherwise(1)).alias("n"),
        (acc["depth"] + F.when(acc["done"], 0).otherwise(F.when(c == "{", 1).when(c == "}", -1).otherwise(0))).alias("depth"),
        (acc["done"] | ((c == "}") & (acc["depth"] == 1))).alias("done"),
    )
    found = F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("done")), step)
    return F.when((start > 0) & found["done"], F.substring(rest, F.lit(1), found["n"]))


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    filled = F.coalesce(F.floor(F.try_divide(done * width, total)), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
