"""Functions for catalogues and reports: estimates, short forms, escapes, report columns. All are built-in expressions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.scalars import QUANT_FORMATS, fence_for, first_of


def bits_of(quant: Column) -> Column:
    """Bits per weight of a weight format, 16 for one that isn't known."""
    return F.coalesce(first_of([(quant == q, b) for q, _, b in QUANT_FORMATS], F.lit(16.0)), F.lit(16.0))


def memory_by_size(size_gb: Column, bits: Column, context: Column) -> Column:
    """Memory in GB where nothing but the file's size is known; null for sizes that are missing or not positive."""
    whole = size_gb * (1.5 + bits / 32 * 0.5 + F.least(context / 32768, F.lit(4.0)) * 0.5)
    return F.when(size_gb > 0, F.when(~(bits > 0) | bits.isNull(), size_gb * 1.5).when(context > 0, whole).otherwise(size_gb * 2.0))


def short_context(n: Column) -> Column:
    """A context length as ``40M``, ``128k`` or ``2048 ``; empty for none."""
    text = F.when(n >= 10_240_000, F.concat(F.floor(n / (1 << 20)).cast("string"), F.lit("M"))).when(n >= 10_000, F.concat(F.floor(n / 1024).cast("string"), F.lit("k"))).when(n > 0, F.concat(n.cast("string"), F.lit(" ")))
    return F.coalesce(text, F.lit(""))


def short_count(n: Column) -> Column:
    """A count as it is below a million, then in thousands, then in millions."""
    return F.when(n < 1_000_000, n.cast("string")).when(n < 1_000_000_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M")))


def fenced(text: Column, limit: int | None = None) -> Column:
    """A text in a fence of its own if it has characters that Markdown reads, cut to ``limit`` with dots then."""
    special = text.rlike(r"(?m)[*_`\[\]()>+\\]|[#=-]+(?=\s|$)|(\r?\n){2,}")
    body = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text) if limit else text
    return F.when(special, F.concat(F.lit("\n"), fence_for(text), F.lit("\n"), body, F.lit("\n"), fence_for(text), F.lit("\n"))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def origin_of(name: Column) -> Column:
    """Which catalogue a model's name belongs to."""
    return F.when(F.startswith(name, F.lit("hf.co/")) | F.lower(name).contains("huggingface"), "huggingface").when(name.isNotNull(), "ollama")


def utc_text(text: Column) -> Column:
    """An ISO time as ``YYYY-MM-DD HH:MM:SS UTC``; without a zone it is in UTC; null where it can't be read."""
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.concat(F.date_format(F.try_to_timestamp(zoned), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def whole_or_zero(text: Column) -> Column:
    """A whole number written with or without commas, 0 for anything else (null too)."""
    return F.coalesce(F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("bigint"), F.lit(0))


def doi_of_file(path: Column) -> Column:
    """The DOI that a file name of the form ``8 hex digits-NAME.YEAR.NUMBER.ext`` stands for, or null."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^[a-f0-9]{8}-[A-Za-z]+\.[0-9]{4}\.[0-9]+"), F.concat(F.lit("10.1109/"), F.upper(F.substring(base, F.lit(10), F.length(base) - 13))))


# The ends of the keys under which a model's figures stand, in order.
FIGURES = {"num_layers": "block_count", "num_kv_heads": "head_count_kv", "head_count": "head_count", "embedding_length": "embedding_length", "context_length": "context_length", "param_count": "parameter_count", "head_dim": "attention.key_length"}
SIGHT = r"(?i)\.vision\.|\.visual\.|mmproj|projector"


def model_figures(info: Column) -> Column:
    """A struct of whole numbers from a map of key -> JSON text: the first key for each figure, keys of the vision part
    left out, lists as their mean rounded up; the head's width falls back to the embedding's by the heads."""
    plain = F.filter(F.map_entries(info), lambda e: ~e["key"].rlike(SIGHT))

    def figure(end: str) -> Column:
        values = F.transform(F.filter(plain, lambda e: F.endswith(e["key"], F.lit(f".{end}"))), lambda e: e["value"])
        lists = F.from_json(F.get(values, F.lit(0)), "array<double>")
        mean = F.ceil(F.aggregate(lists, F.lit(0.0), lambda a, x: a + x) / F.size(lists))
        return F.when(F.startswith(F.get(values, F.lit(0)), F.lit("[")), mean).otherwise(F.get(values, F.lit(0)).try_cast("bigint"))

    got = {k: figure(v) for k, v in FIGURES.items()}
    got["head_dim"] = F.coalesce(got["head_dim"], F.floor(F.try_divide(got["embedding_length"], got["head_count"])))
    return F.struct(*[got[k].alias(k) for k in FIGURES if k != "head_count"])


def factor_steps(factor: Column) -> Column:
    """A factor as a list of steps between 0.5 and 2 whose product it is, as filter names; none for 1."""
    up, down = F.greatest(F.ceil(F.log2(factor)) - 1, F.lit(0)).cast("int"), F.greatest(-F.floor(F.log2(factor)) - 1, F.lit(0)).cast("int")
    rest = factor / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    steps = F.concat(F.array_repeat(F.lit("atempo=2.0"), up), F.array_repeat(F.lit("atempo=0.5"), down), F.when(rest != 1, F.array(F.format_string("atempo=%5.3f", F.bround(rest, 3)))).otherwise(F.array().cast("array<string>")))
    return F.when(factor > 0, steps)


def title_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def context_size(info: Column, parameters: Column, default: int = 2048) -> Column:
    """The context length: a key of the map that ends so, else the ``num_ctx`` line of the parameters, else the default."""
    keyed = F.get(F.transform(F.filter(F.map_entries(info), lambda e: F.endswith(e["key"], F.lit(".context_length"))), lambda e: e["value"]), F.lit(0))
    return F.coalesce(keyed.try_cast("int"), F.regexp_extract(parameters, r"(?im)^\s*num_ctx\b.*?(\d+)\s*$", 1).try_cast("int"), F.lit(default))


def chunk_size(context: Column, for_query: bool = False) -> Column:
    """Three quarters of the context, 256 at least, and 4,096 at most unless it is for a query."""
    size = F.greatest(F.lit(256), F.floor(context * 3 / 4)).cast("int")
    return size if for_query else F.least(size, F.lit(4096))


def word_hits(text: Column, words: list[str], low: int, high: int) -> Column:
    """How many of two tests a text passes: it has one of the words; its number of words lies between the limits."""
    some = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(text).contains(w))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return some.cast("int") + ((n > low) & (n < high)).cast("int")


def filled_label(text: Column, label: str, value: Column) -> Column:
    """The text with a value behind a label that stands without one; other texts stay."""
    return F.when(text.contains(label) & (value != ""), F.replace(text, F.lit(label), F.concat(F.lit(f"{label} "), value))).otherwise(text)


def any_of_all(groups: Column) -> Column:
    """``("a" OR "b") AND ("c")`` of an array of arrays of terms."""
    quoted = F.transform(groups, lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "), F.lit(")")))
    return F.array_join(quoted, " AND ")


def cell(text: Column, width: int, right: bool = False) -> Column:
    """A text at a fixed width: what is longer is cut and ends with dots."""
    cut = F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))
    return F.lpad(cut, width, " ") if right else F.rpad(cut, width, " ")


def table_line(columns: dict[str, tuple[int, bool, Callable[[], Column]]], show: list[str]) -> Column:
    """One line of a text table; ``columns``: name -> (width, right-aligned, expression), ``show``: which, in order."""
    return F.concat_ws(" ", *[cell(columns[n][2]().cast("string"), columns[n][0], columns[n][1]) for n in show])
