"""String and JSON expressions: timecodes, rates, file names, model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number prefix as a browser parses it; file-name suffix of an original;
# opening and closing mark of a code fence.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
ORIGINAL_SUFFIX = r"(?i)_original\.\w+$"
FENCE_OPEN = r"^```(?:json)?\s*"
FENCE_CLOSE = r"\s*```$"


def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")


def parse_timecode(text: Column) -> Column:
    """Seconds of ``H:M:S.mmm`` or ``M:S.mmm``; otherwise the number, or 0."""
    parts = F.split(text, ":")
    part = [leading_number(F.get(parts, F.lit(i))) for i in range(3)]
    return (
        F.when(F.size(parts) == 3, part[0] * 3600 + part[1] * 60 + part[2])
        .when(F.size(parts) == 2, part[0] * 60 + part[1])
        .otherwise(F.coalesce(leading_number(text), F.lit(0.0)))
    )


def parse_rate(text: Column) -> Column:
    """Value of ``n/d`` or a plain number; bad text and zero denominators give 0."""
    parts = F.split(text, "/")
    numerator = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    denominator = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    value = (
        F.when(F.size(parts) == 1, numerator)
        .when(F.size(parts) == 2, F.try_divide(numerator, denominator))
    )
    return F.coalesce(value, F.lit(0.0))


def _pad2(value: Column) -> Column:
    return F.lpad(value.cast("long").cast("string"), 2, "0")


def format_duration(seconds: Column) -> Column:
    """``m:ss``."""
    return F.concat_ws(":", F.floor(seconds / 60).cast("string"), _pad2(F.floor(seconds % 60)))


def format_timestamp(seconds: Column) -> Column:
    """``m:ss.cc`` with truncated hundredths."""
    hundredths = _pad2(F.floor((seconds % 1) * 100))
    return F.concat_ws(".", format_duration(seconds), hundredths)


def format_clock(seconds: Column) -> Column:
    """``MM:SS.mmm``."""
    minutes = F.floor(F.floor(seconds) / 60)
    return F.format_string("%02d:%06.3f", minutes, seconds - minutes * 60)


def media_url(project: Column, video_hash: Column, filename: Column, kind: str = "original") -> Column:
    """Served path of an original file or of its downsampled copy."""
    name = filename
    if kind == "downsampled":
        name = F.concat(F.regexp_replace(filename, ORIGINAL_SUFFIX, ""), F.lit("_downsampled.mp4"))
    return F.concat(F.lit("/files/"), project, F.lit("/videos/"), video_hash, F.lit("/"), name)


def file_uri(path: Column) -> Column:
    """``file://`` URI of an absolute path with percent-encoding, slashes kept."""
    encoded = F.url_encode(path)
    for source, target in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(source), F.lit(target))
    return F.concat(F.lit("file://"), encoded)


# -- model responses ------------------------------------------------------

def strip_fences(text: Column) -> Column:
    """Remove a surrounding code fence; its closing mark may be missing."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, FENCE_OPEN, ""), FENCE_CLOSE, "")


def first_object(json_text: Column) -> Column:
    """Text of a JSON object; of an array, its first element; null when invalid."""
    valid = F.try_parse_json(json_text)
    is_array = F.regexp_like(json_text, F.lit(r"^\s*\["))
    is_object = F.regexp_like(json_text, F.lit(r"^\s*\{"))
    return (
        F.when(valid.isNull(), F.lit(None).cast("string"))
        .when(is_array, F.get_json_object(json_text, "$[0]"))
        .when(is_object, json_text)
    )


def parse_fenced_json(text: Column, schema: str) -> Column:
    """Typed value of a possibly fenced JSON object or of the first one in an array."""
    return F.from_json(first_object(strip_fences(text)), schema, {"mode": "PERMISSIVE"})


def unwrap_list(json_text: Column, key: str, element_schema: str) -> Column:
    """The list under ``key``, or the text itself when it is a list."""
    wrapped = F.from_json(json_text, f"struct<`{key}`:array<{element_schema}>>")[key]
    bare = F.from_json(json_text, f"array<{element_schema}>")
    is_array = F.regexp_like(json_text, F.lit(r"^\s*\["))
    return F.when(is_array, bare).otherwise(wrapped)


def unwrap_description(json_text: Column) -> Column:
    """``vlm.description`` when the wrapper exists, else ``description``; empty gives null."""
    wrapped = F.get_json_object(json_text, "$.vlm").isNotNull()
    value = F.when(wrapped, F.get_json_object(json_text, "$.vlm.description")).otherwise(
        F.get_json_object(json_text, "$.description"))
    return F.nullif(value, F.lit(""))
