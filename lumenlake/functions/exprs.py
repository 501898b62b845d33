"""Scalar expressions of the library model, as Columns; all stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension.
MEDIA_TYPES = {
    "photo": ("jpg", "jpeg", "png", "webp", "heic", "heif", "avif", "tiff", "tif", "bmp", "gif", "raw", "arw", "cr2", "cr3", "nef", "orf", "rw2", "dng", "raf", "psd", "svg", "ico"),
    "video": ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "flv", "3gp", "ts", "mts", "m2ts", "mpeg", "mpg", "mxf", "vob"),
    "audio": ("mp3", "flac", "wav", "aac", "ogg", "m4a", "wma", "opus", "aiff"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "md", "rtf", "odt", "ods", "odp", "pages", "numbers", "key"),
}
# Fixed value: how much of either end a fingerprint reads.
FINGERPRINT_EDGE = 64 * 1024


def live(action: Column) -> Column:
    """Not marked deleted; a missing action counts as live."""
    return ~action.eqNullSafe("DELETED")


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given; true for none."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + F.lit(0.5))


def percentage(part: Column, total: Column) -> Column:
    """Share of total in percent with one decimal; a total of 0 counts as 1."""
    return half_up(part / F.when(total == 0, 1).otherwise(total) * 1000) / 10


def geo_cell(degrees: Column) -> Column:
    """Tenths of a degree, halves upwards, worked out in decimals."""
    return F.floor(degrees.cast("decimal(18,9)") * 10 + F.lit("0.5").cast("decimal(2,1)")).cast("int")


def extension_of(name: Column) -> Column:
    """The name's extension in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def plain_extension(extension: Column) -> Column:
    """An extension in lower case without a leading dot."""
    return F.lower(F.regexp_replace(extension, r"^\.", ""))


def media_type(extension: Column) -> Column:
    """photo, video, audio, document or other."""
    low = plain_extension(extension)
    chain = reduce(lambda acc, kv: acc.when(low.isin(*kv[1]), kv[0]), MEDIA_TYPES.items(), F.when(F.lit(False), ""))
    return chain.otherwise("other")


def slashed(path: Column) -> Column:
    """The path with forward slashes."""
    return F.translate(path, "\\", "/")


def top_folder(path: Column) -> Column:
    """The first part of a path; / for a file at the root."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("/")


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything below it; no wildcard has a meaning."""
    return (path == folder) | path.startswith(f"{folder}/")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def fingerprint(size: Column, text: Column, edge: int = FINGERPRINT_EDGE) -> Column:
    """Digest of a text's size, its first characters, and, where it is longer than these, its last ones."""
    tail = F.when(F.length(text) > edge, F.right(text, F.lit(edge))).otherwise("")
    return F.sha2(F.concat(size.cast("string"), F.left(text, F.lit(edge)), tail), 256)


def human_bytes(size: Column) -> Column:
    """A size in B, KB, MB, GB or TB with one decimal."""
    out = F.concat(F.format_number(size / F.lit(1024.0**4), 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.format_number(size / F.lit(1024.0**power), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 if they do not meet."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)
