"""Book metadata as Column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of ids derived from a text that is no UUID; our own.
NAMESPACE = "5f2c6a0e-3b1d-4c55-9d0e-7a41c2b8e913"


def uuid5(text: Column, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID: SHA-1 of the namespace and the text, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def book_id(text: Column) -> Column:
    """The text if it is a UUID, else one derived from it."""
    return F.when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(text)).otherwise(uuid5(F.coalesce(text, F.lit(""))))


def title(text: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), file_name)


#: Languages by their own names, for books that give no tag.
NATIVE_NAMES = {"english": "en", "deutsch": "de", "français": "fr", "español": "es", "italiano": "it", "русский": "ru", "українська": "uk", "polski": "pl"}


def _lookup(names: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(names.items())))


def language(text: Column, default: str = "ru") -> Column:
    """A language tag in lower case; else the tag of a native name; else the default."""
    raw = F.lower(F.trim(text))
    return F.when(raw.rlike("^[a-z]{2,3}(-[a-z0-9]{2,8})*$"), raw).otherwise(F.coalesce(F.try_element_at(_lookup(NATIVE_NAMES), raw), F.lit(default)))


def genres(values: Column) -> Column:
    return F.filter(F.transform(values, lambda g: F.trim(g)), lambda g: g != "")


def authors(values: Column) -> Column:
    """Authors (first, middle, last), trimmed, that have any name at all."""
    clean = lambda a, part: F.trim(F.coalesce(a[part], F.lit(""))).alias(part)
    trimmed = F.transform(values, lambda a: F.struct(clean(a, "first"), clean(a, "middle"), clean(a, "last")))
    return F.filter(trimmed, lambda a: F.concat(a["first"], a["middle"], a["last"]) != "")


def series_number(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("int")), F.lit(0))


def bad_series_number(text: Column) -> Column:
    return (text != "") & ~text.rlike("^[0-9]+$")


#: Leading bytes and extensions of media types.
MAGIC = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("3C737667", "image/svg+xml"))
BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "css": "text/css", "xhtml": "application/xhtml+xml"}
UNKNOWN = "application/octet-stream"


def media_type_by_content(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), UNKNOWN)
    for magic, kind in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    return out.otherwise(UNKNOWN)


def media_type_by_extension(extension: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(BY_EXTENSION), F.lower(extension)), F.lit(UNKNOWN))


CONVERT, OPAQUE, SCALE, OPTIMIZE = 1, 2, 4, 8


def image_flags(media_type: Column, opaque: Column, scale: Column, optimize: Column) -> Column:
    """What has to be done to an image, as bits: no reader displays the type; transparency; size; JPEG quality."""
    flag = lambda condition, bit: F.when(condition, bit).otherwise(0)
    bits = flag(~media_type.isin("image/gif", "image/bmp", "image/jpeg", "image/png"), CONVERT)
    bits = bits.bitwiseOR(flag((media_type == "image/png") & opaque, OPAQUE)).bitwiseOR(flag(scale, SCALE))
    return bits.bitwiseOR(flag((media_type == "image/jpeg") & optimize, OPTIMIZE))
