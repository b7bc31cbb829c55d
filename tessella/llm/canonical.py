"""One consistent form for texts that look the same but are made of different characters.

Method: a transducer over grapheme clusters. A cluster is a character with the combining marks and invisible
characters that follow it; the longest cluster is matched, and its output comes from a mapping that is
precomputed from the Unicode data and the look-alike tables below and checked for conflicts when it is built:
no character has two outputs, and every output is its own output (one pass is enough). Texts are read once;
pure ASCII stretches are copied as they are.

Kept apart: letter case, line breaks, accents (in one composed form), superscripts, fractions, circled and
squared characters, dashes longer than a hyphen, and letters that a reader can tell from the Latin ones, such as the
i without a dot. Null stays null. The digests of all forms are written once; texts are canonicalised a single time.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.session import durable

# Characters drawn like Latin letters, and the letters they are drawn like.
LOOK_ALIKES = {
    "Cyrillic small": ("асԁеһіјӏорԛѕԝхуү", "acdehijlopqswxyy"),
    "Cyrillic capital": ("АВСЕНІЈКМОРԚЅТԜХҮ", "ABCEHIJKMOPQSTWXY"),
    "Greek small": ("ορν", "opv"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    "Armenian small": ("օոսցհ", "onugh"),
    "Armenian capital": ("ՕՍԼՏ", "OULS"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏞᏟᏢᏦᏴᏚ", "DRTAJEWMHYGZ4RWLCPKBS"),
    "Coptic": ("ⲞⲟⲢⲣⲤⲥⲔⲘⲦⲬⲎⲒⲀⲂ", "OoPpCcKMTXHIAB"),
    "Latin letters of phonetics": ("ɑɡ", "ag"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "signs": ("‐‑⁃−﹣µ∶ꞏ∕", "-----μ:·/"),
}
# Characters that take no room on the line.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿"
LINE_BREAKS = {"\r\n": "\n", "\r": "\n", "\x85": "\n", " ": "\n", " ": "\n"}


def _plain(ch: str) -> str | None:
    """The output of one character by rule, or None if it keeps its own."""
    category = unicodedata.category(ch)
    if category == "Zs" or ch == "\t":
        return " "
    if category in ("Cf", "Cc") and ch in INVISIBLE:
        return ""
    if "VARIATION SELECTOR" in unicodedata.name(ch, ""):
        return ""
    kind, _, rest = unicodedata.decomposition(ch).partition("> ")
    if kind in ("<wide", "<narrow", "<font"):
        return "".join(chr(int(x, 16)) for x in rest.split())
    if kind == "<compat" and (0xFB00 <= ord(ch) <= 0xFB06 or 0x2160 <= ord(ch) <= 0x217F or ord(ch) in (0x2024, 0x2025, 0x2026) or 0x0132 <= ord(ch) <= 0x0133 or 0x01C4 <= ord(ch) <= 0x01CC or 0x01F1 <= ord(ch) <= 0x01F3):
        return "".join(chr(int(x, 16)) for x in rest.split())
    return None


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Character -> output; raises ValueError on a conflict."""
    out: dict[str, str] = {}

    def put(ch: str, to: str) -> None:
        if out.setdefault(ch, to) != to:
            raise ValueError(f"two outputs for U+{ord(ch):04X}")

    for name, (shapes, letters) in LOOK_ALIKES.items():
        if len(shapes) != len(letters):
            raise ValueError(f"look-alike table {name} is uneven")
        for shape, letter in zip(shapes, letters):
            put(shape, letter)
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF or 0x3400 <= code <= 0x9FFF or 0x20000 <= code <= 0xE00FF or code >= 0xE01F0:
            continue
        ch = chr(code)
        if (to := _plain(ch)) is not None:
            put(ch, to)
    put("\t", " ")
    for ch, to in list(out.items()):
        for _ in range(4):  # outputs that are themselves mapped: follow them once, here, instead of at run time
            done = "".join(out.get(x, x) for x in unicodedata.normalize("NFD", to))
            if done == to:
                break
            to = done
        out[ch] = to
    for ch, to in out.items():
        if "".join(out.get(x, x) for x in to) != to:
            raise ValueError(f"the output of U+{ord(ch):04X} is mapped again")
    return out




def _marks() -> str:
    """A character class of all combining marks, of the joining letters of syllables, and of what takes no room."""
    codes = [c for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M" or 0x1160 <= c <= 0x11FF]
    spans, begin = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            spans.append(f"{chr(begin)}-{chr(a)}")
            begin = b
    return "".join(spans) + re.escape(INVISIBLE)


_MARKS = _marks()
_CLUSTER = re.compile(rf"\r\n?|\t|[\x20-\x7e][{_MARKS}]*|[^\x00-\x7f][{_MARKS}]*")
_RUN = re.compile(r"[\x20-\x7e]?[^\x00-\x7f]+|\r\n?|\t")  # clusters that can change, with the letter before them


class Transducer:
    """Cluster -> output, each distinct cluster worked out once; short runs of clusters are remembered whole."""

    def __init__(self) -> None:
        self.single = mapping()
        self.known: dict[str, str] = dict(LINE_BREAKS)
        self.runs: dict[str, str] = {}

    def _cluster(self, match: re.Match) -> str:
        cluster = match.group()
        out = self.known.get(cluster)
        if out is None:
            out = unicodedata.normalize("NFC", "".join(self.single.get(c, c) for c in unicodedata.normalize("NFD", cluster)))
            if len(self.known) < 200_000:
                self.known[cluster] = out
        return out

    def _run(self, match: re.Match) -> str:
        run = match.group()
        out = self.runs.get(run)
        if out is None:
            out = _CLUSTER.sub(self._cluster, run)
            if len(run) <= 24 and len(self.runs) < 500_000:
                self.runs[run] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii() and "\t" not in text and "\r" not in text:
            return text
        return _RUN.sub(self._run, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Column of texts in the one form in which texts that look the same are equal."""
    run = transducer()
    return pd.Series([run(t) if t is not None else None for t in texts], dtype=object)


def look_alike_keys(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, raw, form): digests of each text and of its one form; rows with null text are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null")
    digest = lambda c: F.unhex(F.md5(c))
    return rows.select("id", digest(F.col("text")).alias("raw"), digest(canonical_text(F.col("text"))).alias("form"))


def look_alike_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, class_id, variants): every document with the smallest id of its class and the class's number of spellings.

    Null texts form no class and are left out; the empty text is a text like any other.
    """
    keys = durable(look_alike_keys(df, id_col, text), "keys")
    spellings = keys.groupBy("form", "raw").agg(F.min("id").alias("first"))
    classes = spellings.groupBy("form").agg(F.min("first").alias("class_id"), F.count("*").alias("variants"))
    return keys.join(classes, "form").select("id", "class_id", "variants")


def look_alike_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_a, id_b): pairs of documents whose texts differ as strings but have the same form.

    Forms with one spelling only, such as a text copied unchanged into a third of all rows, are dropped by
    aggregation before the join; what remains is as large as the result asked for.
    """
    keys = durable(look_alike_keys(df, id_col, text), "keys")
    mixed = keys.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    few = keys.join(mixed, "form", "left_semi")
    a, b = (few.select("form", F.col("id").alias(f"id_{s}"), F.col("raw").alias(f"raw_{s}")) for s in "ab")
    return a.join(b, "form").where("id_a < id_b and raw_a <> raw_b").select("id_a", "id_b")
