"""Splitting oversized items at natural boundaries, with overlap, so that an edit alters neighbouring pieces only.

Method: content-defined chunking. A rolling hash over the bytes marks landmarks; the cut is the first landmark
between the minimum and maximum size, snapped to the nearest natural boundary of the strongest kind near it
(paragraph, line, sentence, word, character). Since landmarks depend on the bytes around them only, the cuts fall
into step again soon after an edit. A piece is the stretch between two cuts, begun ``overlap`` bytes earlier at a
natural boundary; the stretch is kept short enough for the piece to stay within the limit. An overlap may be up to 8 bytes
less than the limit, so that every piece gets on; a larger one is cut to that.

All sizes and offsets count UTF-8 bytes; a character is never divided. Lines end in LF or CR LF. Null texts are
left out, texts within the limit come out whole, an unknown suffix takes the limit of the empty one, and a null
offset or line stays null in the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.canonical import INVISIBLE

PIECE_SCHEMA = (
    "item_no bigint, piece_no int, byte_offset bigint, line_start bigint, line_end bigint, n_bytes int, text string, "
    "paragraph_offset bigint, paragraph_line_start bigint, paragraph_line_end bigint"
)
_VISIBLE = re.compile(rf"[^\s\x00-\x1f\x7f{re.escape(INVISIBLE)}]")
_WINDOW = 32
_GEAR = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?;:"])


def suffix_of(path: Column) -> Column:
    """The lower-case suffix of a path of either kind, empty if its last part has none."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.\s]*)$", 1))


def paragraphs(text: str) -> list[tuple[int, int, int, int]]:
    """(first byte, end byte without the last line break, first line, last line) of each run of visible lines."""
    out, at, first, end = [], 0, None, 0
    lines = text.split("\n")
    for n, line in enumerate(lines):
        size = len(line) if line.isascii() else len(line.encode())
        if _VISIBLE.search(line):
            first = (at, n) if first is None else first
            end = at + size - (line.endswith("\r") and n < len(lines) - 1)
        elif first is not None:
            out.append((first[0], end, first[1], n - 1))
            first = None
        at += size + 1
    if first is not None:
        out.append((first[0], end, first[1], len(lines) - 1))
    return out


def landmarks(data: np.ndarray, every: int) -> np.ndarray:
    """Positions whose preceding bytes hash to a landmark, about one in ``every``."""
    if len(data) <= _WINDOW:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        gear, total = _GEAR[data], np.zeros(len(data) - _WINDOW + 1, dtype=np.uint64)
        for k in range(_WINDOW):
            total = total * np.uint64(3) + gear[k : k + len(total)]
        mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(max(2, every)) == 0) + _WINDOW


def boundaries(data: np.ndarray, cuts_at_paragraphs: list[int]) -> list[np.ndarray]:
    """Positions where a piece may begin or end, strongest kind first: paragraph, line, sentence, word, character."""
    n = len(data)
    space = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    line = np.flatnonzero(data == 10) + 1
    after_space = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    before = data[np.maximum(after_space - 2, 0)]
    sentence = after_space[_ENDS[before]]
    return [np.array([p for p in cuts_at_paragraphs if 0 < p < n], dtype=np.int64), line[line < n], sentence, after_space, np.flatnonzero((data & 0xC0) != 0x80)]


def _nearest(kinds: list[np.ndarray], want: int, low: int, high: int) -> int | None:
    """The nearest boundary to ``want`` of the strongest kind that has one in [low, high]."""
    for kind in kinds:
        i, j = np.searchsorted(kind, [low, high + 1])
        if i < j:
            k = int(np.searchsorted(kind, want))
            near = [int(kind[x]) for x in (k - 1, k) if i <= x < j] or [int(kind[i]) if want < low else int(kind[j - 1])]
            return min(near, key=lambda p: abs(p - want))
    return None


def split_bytes(data: np.ndarray, limit: int, overlap: int, paragraph_starts: list[int]) -> list[tuple[int, int, int]]:
    """(begin, core begin, end) of the pieces of a text; begin is earlier than core begin by the overlap."""
    n = len(data)
    if n <= limit:
        return [(0, 0, n)]
    overlap = max(0, min(overlap, limit - 8))
    slack = min(48, overlap, max(0, limit - overlap - 4))  # room for moving the overlap's begin back to a boundary
    most = max(4, limit - overlap - slack)
    least, every = max(4, most // 3), max(2, most // 4)
    kinds, marks, out, core = boundaries(data, paragraph_starts), landmarks(data, every), [], 0
    while True:
        begin = core
        if core and overlap:
            want = max(0, core - overlap)
            begin = _nearest(kinds[:4], want, max(0, want - slack), want)
            if begin is None:
                at = int(np.searchsorted(kinds[4], want, side="right")) - 1
                begin = int(kinds[4][at] if want - kinds[4][at] <= slack else kinds[4][at + 1])
        if n - begin <= limit:
            out.append((begin, core, n))
            return out
        low, high = core + least, min(core + most, n - 1)
        i = int(np.searchsorted(marks, low))
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut = _nearest(kinds[:4], mark, max(low, mark - every), min(high, mark + every)) or _nearest(kinds[:4], mark, low, high) or _nearest(kinds[4:], high, core + 1, high)
        if cut is None or cut <= core:  # a limit smaller than one character
            later = kinds[4][kinds[4] > core]
            cut = int(later[0]) if len(later) else n
        out.append((begin, core, cut))
        core = cut
        if core >= n:
            return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple]:
    """Pieces as (begin, first line, last line, text, oversize paragraph or None), relative to the text."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return [(0, 0, text.count("\n"), text, None)]
    data = np.frombuffer(raw, dtype=np.uint8)
    blocks = paragraphs(text)
    large = [b for b in blocks if b[1] - b[0] > limit]
    breaks, out = np.flatnonzero(data == 10), []
    for begin, core, end in split_bytes(data, limit, overlap, [b[0] for b in blocks]):
        inside = next((b for b in large if b[0] < core < b[1]), None)
        first, last = (int(x) for x in np.searchsorted(breaks, [begin, end]))
        out.append((begin, first, last, raw[begin:end].decode("utf-8", "surrogatepass"), inside))
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for item, offset, line, text, limit, overlap in zip(*(batch[c].tolist() for c in ("item_no", "byte_offset", "line_start", "text", "max_bytes", "overlap_bytes"))):
            add = lambda base, x: None if base is None or base != base else int(base) + x
            for k, (begin, first, last, piece, inside) in enumerate(split_text(text, int(limit), int(overlap))):
                where = (add(offset, inside[0]), add(line, inside[2]), add(line, inside[3])) if inside else (None, None, None)
                out.append((item, k, add(offset, begin), add(line, first), add(line, last), len(piece.encode("utf-8", "surrogatepass")), piece, *where))
        frame = pd.DataFrame(out, columns=columns)
        for c in columns:
            if c != "text":
                frame[c] = frame[c].astype("Int64")
        yield frame


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all items, see PIECE_SCHEMA; paragraph_* name the oversize paragraph a piece had to be begun in.

    ``items`` has item_no, file_path, byte_offset, line_start and text; ``limits`` has suffix, max_bytes and
    overlap_bytes, one row per suffix. Both only lend these columns. A limit table is small by nature; it is
    joined as any other table, so its size decides how.
    """
    lim = limits.select(F.coalesce(F.lower("suffix"), F.lit("")).alias("suffix"), "max_bytes", "overlap_bytes").where("max_bytes > 0").dropDuplicates(["suffix"])
    default = lim.where("suffix = ''").agg(F.min("max_bytes").alias("d_max"), F.min("overlap_bytes").alias("d_overlap"))
    rows = items.select(F.col("item_no").cast("bigint").alias("item_no"), F.coalesce(suffix_of(F.col("file_path")), F.lit("")).alias("suffix"), F.col("byte_offset").cast("bigint").alias("byte_offset"), F.col("line_start").cast("bigint").alias("line_start"), "text").where("text is not null")
    d_max, d_overlap = default.first()
    known = rows.join(lim, "suffix", "left").select(
        "item_no", "byte_offset", "line_start", "text",
        F.coalesce("max_bytes", F.lit(d_max), F.lit(1 << 30)).cast("int").alias("max_bytes"), F.coalesce("overlap_bytes", F.lit(d_overlap), F.lit(0)).cast("int").alias("overlap_bytes"),
    )
    return known.mapInPandas(_pieces, PIECE_SCHEMA)


def piece_checks(pieces: DataFrame, items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_no, n_bytes, whole, within, lines): per item with known offset and lines, from its pieces: the bytes from the
    first one's begin to the last one's end, whether no byte is left out between them, whether all are within the limit
    (or one character), and whether the lines counted are those of the item."""
    w = Window.partitionBy("item_no", "at").orderBy("piece_no")
    # copies of an item have the same number; their pieces are told apart by where the copy begins
    begins = F.min(F.when(F.col("piece_no") == 0, F.col("byte_offset")))
    first = pieces.groupBy("item_no").agg(begins.alias("at"))
    placed = pieces.join(first, "item_no").where("at is not null")
    end = F.col("byte_offset") + F.col("n_bytes")
    steps = placed.withColumn("gap", F.col("byte_offset") > F.coalesce(F.lag(end).over(w), F.col("byte_offset")))
    lim = limits.select(F.coalesce(F.lower("suffix"), F.lit("")).alias("suffix"), F.col("max_bytes").alias("most")).dropDuplicates(["suffix"])
    own = items.select("item_no", F.coalesce(suffix_of(F.col("file_path")), F.lit("")).alias("suffix"), "line_start", "line_end").join(lim, "suffix", "left").join(lim.where("suffix = ''").select(F.col("most").alias("rest")).limit(1), F.lit(True), "left")
    facts = steps.groupBy("item_no", "at").agg((F.max(end) - F.min("byte_offset")).alias("n_bytes"), (~F.bool_or("gap")).alias("whole"), F.max("n_bytes").alias("largest"), F.min("line_start").alias("l0"), F.max("line_end").alias("l1"))
    return facts.join(own, "item_no").select("item_no", "n_bytes", "whole", (F.col("largest") <= F.greatest(F.coalesce("most", "rest"), F.lit(4))).alias("within"), ((F.col("l0") == F.col("line_start")) & (F.col("l1") == F.col("line_end"))).alias("lines"))


def oversize_paragraphs(pieces: DataFrame) -> DataFrame:
    """The paragraphs that had to be cut inside, from the pieces begun in them (each such paragraph has one or more)."""
    cut = pieces.where("paragraph_line_start is not null")
    return cut.select("item_no", F.col("paragraph_offset").alias("byte_offset"), F.col("paragraph_line_start").alias("line_start"), F.col("paragraph_line_end").alias("line_end")).distinct()
