"""Scalar functions on columns: all built-in expressions, so they stay inside whole-stage code generation.

Null in, null out, unless said otherwise. Malformed text gives null (or the default named) and never fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of weight formats in the order in which they are looked for, rank (None: not to be chosen) and bits per weight.
QUANT_FORMATS = [
    ("F32", 1, 32.0), ("BF16", None, 16.0), ("F16", 3, 16.0), ("Q8_0", 10, 8.5), ("Q8_1", 11, 9.0), ("Q6_K", 20, 6.5625), ("Q6_K_L", 21, 6.5625),
    ("Q5_K_H", 30, 5.5), ("Q5_K_L", 31, 5.5), ("Q5_K_M", 32, 5.5), ("Q5_K_S", 33, 5.5), ("Q5_1", 34, 6.0), ("Q5_0", 35, 5.0),
    ("Q4_K_L", 40, 4.5), ("Q4_K_M", 41, 4.5), ("Q4_K_S", 42, 4.5), ("IQ4_NL", 43, 4.5), ("IQ4_XS", 44, 4.25), ("Q4_1", 45, 5.0), ("Q4_0", 46, 4.5),
    ("Q3_K_XL", 50, 3.9375), ("Q3_K_L", 51, 3.875), ("IQ3_M", 52, 3.7), ("Q3_K_M", 53, 3.875), ("IQ3_S", 54, 3.5), ("Q3_K_S", 55, 3.5), ("IQ3_XS", 56, 3.3), ("IQ3_XXS", 57, 3.06),
    ("Q2_K_L", 60, 2.625), ("Q2_K", 61, 2.625), ("Q2_K_S", 62, 2.5), ("IQ2_M", 63, 2.7), ("IQ2_S", 64, 2.5), ("IQ2_XS", 65, 2.31), ("IQ2_XXS", 66, 2.0625),
    ("IQ1_M", 70, 1.75), ("IQ1_S", 71, 1.5625), ("Q1_0", 72, 1.0),
]
# Kinds of models and the patterns of their names, in order.
KIND_PATTERNS = [
    ("code", "code|coder|codestral|starcoder|codellama|wizardcoder|phind|magicoder|codegen|replit|stable-code|granite-code|qwen.*coder|deepseek.*code|claude|teichai"),
    ("embed", "embed"),
    ("vision", "vision|llava|bakllava|moondream|cogvlm|minicpm-v|internvl|paligemma|qwen.*vl|yi-vl|bunny|nanollava|obsidian|pixtral|llama.*vision|-vl"),
    ("medical", "medical|extract|path"),
    ("geo", "geo|extract|path"),
]


def first_of(conditions: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in conditions], otherwise)


def quant_format(name: Column) -> Column:
    """The first known format whose name occurs in a file name, ``UNKNOWN`` if none does."""
    shape = F.replace(F.upper(name), F.lit("-"), F.lit("_"))
    return F.when(name.isNotNull(), first_of([(shape.contains(q), q) for q, _, _ in QUANT_FORMATS], F.lit("UNKNOWN")))


def kind_of(name: Column) -> Column:
    """The first kind with a pattern that the lower-case name matches, or null."""
    return first_of([(F.lower(name).rlike(p), k) for k, p in KIND_PATTERNS], F.lit(None).cast("string"))


def count_lenient(text: Column) -> Column:
    """``15.8M`` as 15800000; anything else that is no whole number is 0."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    scale = F.when(F.upper(t).endswith("K"), 1e3).when(F.upper(t).endswith("M"), 1e6).when(F.upper(t).endswith("B"), 1e9)
    scaled = F.try_multiply(F.substring(t, F.lit(1), F.length(t) - 1).try_cast("double"), scale)
    return F.when(text.isNotNull(), F.coalesce(F.when(scale.isNotNull(), F.floor(scaled + F.lit(1e-6))).otherwise(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))), F.lit(0)).cast("bigint"))


def count_strict(text: Column) -> Column:
    """As count_lenient, but null for anything that is no positive count."""
    t = F.rtrim(F.trim(text), F.lit(","))
    body = F.trim(F.substring(t, F.lit(1), F.length(t) - 1))
    scale = F.when(F.upper(t).endswith("K"), 1e3).when(F.upper(t).endswith("M"), 1e6).when(F.upper(t).endswith("B"), 1e9)
    scaled = F.floor(F.try_multiply(F.replace(body, F.lit(","), F.lit("")).try_cast("double"), scale) + F.lit(1e-6)).cast("bigint")
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    return F.when(scale.isNotNull(), scaled).when(whole > 0, whole)


def size_in_gb(text: Column) -> Column:
    """``512MB`` as 0.5; a bare number is taken as it is, anything else is 0."""
    t = F.upper(F.trim(text))
    body = F.substring(t, F.lit(1), F.length(t) - 2).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(F.when(t.endswith("GB"), body).when(t.endswith("MB"), body / 1024).when(t.endswith("TB"), body * 1024).otherwise(t.try_cast("double")), F.lit(0.0)))


def context_length(text: Column) -> Column:
    """``128K`` as 131072, a whole number as it is, else null."""
    t = F.upper(F.trim(text))
    body = F.substring(t, F.lit(1), F.length(t) - 1).try_cast("double")
    return F.when(t.endswith("K"), F.floor(body * 1024)).when(t.endswith("M"), F.floor(body * 1048576)).when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).cast("bigint")


def human_bytes(n: Column) -> Column:
    """Bytes in at most five digits and a unit."""
    out = None
    for k, unit in reversed(list(enumerate(" kMGTP"))):
        shown = F.format_string("%.3f", n.cast("double") / float(1 << (10 * k)))
        piece = F.concat(F.substring(shown, 1, 5), F.lit(unit.strip()))
        out = piece if out is None else F.when(F.length(shown) <= 7, piece).otherwise(out)
    return F.when(n < 100000, F.concat(F.lpad(n.cast("bigint").cast("string"), 5, " "), F.lit(" "))).otherwise(out)


def parse_duration(text: Column) -> Column:
    """``[[h:]m:]s[.f]`` in seconds, null if a part is no number."""
    parts = F.transform(F.reverse(F.split(F.trim(text), ":")), lambda p, i: F.try_multiply(p.try_cast("double"), F.pow(F.lit(60.0), i)))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def format_duration(seconds: Column) -> Column:
    """Seconds as ``[h:]m:ss``."""
    s = F.floor(seconds).cast("bigint")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(seconds < 3600, short).when(seconds >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def tag_of_file(name: Column) -> Column:
    """The upper-case last part of a model file's name, without suffix and part number."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?i)\.gguf$", ""), r"-[0-9]{5}-of-[0-9]{5}$", "")
    return F.upper(F.when(base.contains("-"), F.substring_index(base, "-", -1)).otherwise(F.substring_index(base, "_", -1)))


def safe_name(text: Column, default: str = "unnamed") -> Column:
    """A file name: characters that file systems refuse become ``_``; no trailing stops or blanks."""
    clean = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")
    return F.when(clean == "", default).otherwise(clean)


def safe_title(text: Column) -> Column:
    """At most 80 characters, everything but ASCII letters and digits as ``_``."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), 1, 80)


def fence_for(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)")), lambda r: F.length(r))
    return F.when(text.isNotNull(), F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)))


def after_reasoning(text: Column) -> Column:
    """What follows the last closing think tag, trimmed; the whole text if there is none."""
    return F.trim(F.substring_index(text, "</think>", -1))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace, null if there is no such stretch."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def strip_fence(text: Column) -> Column:
    """The body of the first fenced block, the trimmed text if it has none."""
    body = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(text.contains("```"), body).otherwise(text), r"^\s+|\s+$", "")


def middle_out(text: Column, limit: int) -> Column:
    """Text over the limit as its first and last half with dots between."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def words_from_positions(positions: Column) -> Column:
    """A text from its inverted index (word -> positions)."""
    placed = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def to_range(n: Column, low: int, high: int) -> Column:
    """Distance to a range, 0 inside."""
    return F.when(n < low, low - n).when(n > high, n - high).otherwise(0)


def status_label(hits: Column, needed: Column) -> Column:
    return F.when(hits.isNull(), "Unknown").when(needed == 1, F.when(hits >= 1, "PASSED").otherwise("Failed")).when(hits >= needed, "PASSED").otherwise(F.concat(hits.cast("string"), F.lit("/"), needed.cast("string")))


def status_score(status: Column) -> Column:
    """1 for PASSED, the ratio for ``a/b``, 0 for anything else."""
    ratio = F.try_divide(F.split_part(status, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(status, F.lit("/"), F.lit(2)).try_cast("double"))
    return F.when(status == "PASSED", 1.0).when(status.contains("/"), ratio).otherwise(0.0)


def all_of_any(text: Column, groups: list[list[str]]) -> Column:
    """Every group has a term that occurs in the text, case ignored."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in g]) for g in groups])


def missing_as_null(x: Column) -> Column:
    """Zero and the empty text count as missing."""
    return F.nullif(x, F.lit(0))


def content_id(sha: Column, offset: Column, text: Column) -> Column:
    """The content address of a chunk: 32 hex digits over file, offset and text."""
    return F.substring(F.sha2(F.concat_ws(":", sha, offset.cast("string"), text), 256), 1, 32)


def data_url(text: Column, media: str = "text/plain") -> Column:
    """A data URL of a text's UTF-8 bytes, in one line."""
    return F.concat(F.lit(f"data:{media};base64,"), F.regexp_replace(F.base64(F.encode(text, "utf-8")), r"\s", ""))
