"""Evaluation texts leaking into training text, word for word or with other numbers, names and units.

Method: words are the runs of letters and digits of the canonical form (see canonical.py). Template canonicalisation
replaces numbers and units by typed placeholders, whatever their case; a second form of the same window also replaces
names, which are the words that a text writes with a capital. Both depend on the word's own form only, so a name that
no item has is a slot all the same. The windows of ``width`` template words of the items are a table; those of the
documents are joined with it by their hashes, and the slots are checked: equal values make a verbatim leak, a
consistent one-to-one exchange of values makes a re-parameterised one. Since equal windows have equal templates
without names, no verbatim leak is lost, however either text is set.

Scale: the corpus is read once. Its windows are sifted by a bitmap of the items' hashes before anything is shuffled;
the bitmap has MOST_BITS at most, however many items there are, and a full one lets more windows through but loses
none. The join is an ordinary one on a hash, so adaptive execution splits a hot window.

Null or empty texts contain nothing and are contained in nothing; repeated documents are reported one by one. A window
with fewer than a third of its words left beside its slots says too little for a re-parameterised leak; verbatim it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.canonical import transducer
from tessella.session import durable

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NAMED = np.uint64(0x5851F42D4C957F2D)
MOST_BITS = 1 << 26

# Number words and units of measure that count as slots.
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = set("percent kilo kilos kg g gram grams mg tonne tonnes ton tons meter meters metre metres km kilometre kilometres mile miles cm mm second seconds minute minutes hour hours day days week weeks month months year years ms degree degrees litre litres liter liters ml dollar dollars euro euros cent cents byte bytes kb mb gb tb watt watts volt volts".split())

WINDOW_SCHEMA = "id bigint, hash bigint, at int, slots string, told boolean"


def words_of(text: str) -> list[str]:
    """The words a reader sees, case folded."""
    return [w.casefold() for w in _WORD.findall(transducer()(text))]


class Templates:
    """Word -> 64-bit hashes of its template forms without and with name slots, and which of them is a slot."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int]] = {}

    @staticmethod
    def forms(word: str) -> tuple[int, int, int]:
        low = word.casefold()
        slot = "<number>" if low[0].isdigit() or low in NUMBER_WORDS else "<unit>" if low in UNITS else ""
        plain = xxhash.xxh64_intdigest(slot or low)
        if slot:
            return plain, plain, 1
        return (plain, xxhash.xxh64_intdigest("<name>"), 2) if word[0].isupper() else (plain, plain, 0)

    def of(self, words: list[str]) -> np.ndarray:
        """(3, n): plain hashes, hashes with names as slots, kind of slot (0 none, 1 number or unit, 2 name)."""
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.forms(word)
        return np.array([known[w] for w in words], dtype=np.uint64).T


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` words, by differences of prefix sums modulo 2**64."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, dtype=np.uint64))))
        inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - width, _BASE_INVERSE, dtype=np.uint64))))
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(hashes * powers)))
        return (sums[width:] - sums[: n - width + 1]) * inverse


def windows_of(text: str, width: int, templates: Templates, bitmap: np.ndarray | None = None) -> list[tuple[int, int, str, bool]]:
    """(hash, first word, slot values, whether enough words are left) of the windows of a text, in both forms.

    With ``bitmap`` only those whose hash it has.
    """
    cased = _WORD.findall(transducer()(text))
    if len(cased) < width:
        return []
    plain, named, kind = templates.of(cased)
    within = lambda mask: np.lib.stride_tricks.sliding_window_view(mask, width).sum(1)
    names, values = within(kind == 2), within(kind == 1)
    low, out = None, []
    for form, hashes in enumerate((window_hashes(plain, width), window_hashes(named, width) ^ _NAMED)):
        told = (width - values - (names if form else 0)) * 3 >= width
        keep = (names > 0) & told if form else np.ones(len(hashes), dtype=bool)
        if bitmap is not None:
            shift = np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
            at = hashes >> shift
            keep &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        for i in np.flatnonzero(keep).tolist():
            low = low or [w.casefold() for w in cased]
            slots = [low[j] for j in range(i, i + width) if kind[j] and (form or kind[j] == 1)]
            out.append((int(hashes[i].view(np.int64)), i, " ".join(slots), bool(told[i])))
    return out


def _windows(width: int, bitmap):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            rows = [(i, *w) for i, text in zip(batch["id"], batch["text"]) for w in windows_of(text, width, templates, bits)]
            yield pd.DataFrame(rows, columns=["id", "hash", "at", "slots", "told"])

    return run


def _bitmap(windows: DataFrame, n: int, most: int) -> np.ndarray:
    """A bitmap of the upper bits of the windows' hashes: 1,024 bits for each window, ``most`` bits at most."""
    bits = min(most.bit_length() - 1, max(10, (n * 1024).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits)
    rows = windows.select(at.alias("a")).selectExpr("shiftright(a, 6) as word", "shiftleft(1L, cast(a & 63 as int)) as bit")
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # no more rows than the bitmap has words
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def leaks(documents: DataFrame, items: DataFrame, width: int = 12, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document and item that share a window: the document's windows that are verbatim and those that are
    re-parameterised, how many windows the item has and how many of them were met, whether the values are exchanged one
    to one over all of them, and the document's first and last word of the shared stretch.

    ``documents`` has doc_id and text, ``items`` has item_id and text; other columns are ignored.
    """
    texts = lambda df, key: df.select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    asked = durable(texts(items, "item_id").mapInPandas(_windows(width, None), WINDOW_SCHEMA), "windows")
    spark = documents.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(asked, asked.count(), most_bits))
    found = texts(documents, "doc_id").mapInPandas(_windows(width, bitmap), WINDOW_SCHEMA)
    d = found.select(F.col("id").alias("doc_id"), "hash", F.col("at").alias("first"), F.col("slots").alias("here"), "told")
    i = asked.select(F.col("id").alias("item_id"), "hash", F.col("at").alias("there_at"), F.col("slots").alias("there"))
    here, there = F.split("here", " "), F.split("there", " ")
    zipped = F.array_distinct(F.arrays_zip(here.alias("a"), there.alias("b")))
    of = lambda pairs, c: F.size(F.array_distinct(F.transform(pairs, lambda p: p[c])))
    one_to_one = lambda pairs: (F.size(pairs) == of(pairs, "a")) & (F.size(pairs) == of(pairs, "b"))
    exact = F.col("here") == F.col("there")
    met = d.join(i, "hash").select("*", exact.alias("exact"), zipped.alias("slots")).where(F.col("exact") | (F.col("told") & (F.size(here) == F.size(there)) & one_to_one(F.col("slots"))))
    each = met.groupBy("doc_id", "item_id", "first").agg(F.bool_or("exact").alias("exact"), F.collect_set("there_at").alias("met"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    rows = each.groupBy("doc_id", "item_id").agg(
        F.count_if("exact").cast("int").alias("exact_windows"), F.count_if(~F.col("exact")).cast("int").alias("template_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("item_windows_met"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.min("first").alias("first_word"), (F.max("first") + width).alias("last_word"),
    )
    sizes = asked.groupBy(F.col("id").alias("item_id")).agg((F.max("at") + 1).alias("item_windows"))
    return rows.join(sizes, "item_id").select("doc_id", "item_id", "exact_windows", "template_windows", "item_windows", "item_windows_met", one_to_one(F.col("slots")).alias("consistent"), "first_word", "last_word")


def reparameterised(documents: DataFrame, items: DataFrame, width: int = 12, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, template_windows, met): documents that hold an item with other values and nowhere verbatim, if
    its values are exchanged one to one throughout and ``share`` or more of the item's windows are met; less is a phrase
    that many texts share."""
    met = F.col("item_windows_met") / F.col("item_windows")
    return leaks(documents, items, width).where((F.col("exact_windows") == 0) & F.col("consistent") & (met >= share)).select("doc_id", "item_id", "template_windows", met.alias("met"))
