"""Matching entities across sources without keys, each match with a confidence.

Method: random walks over the record-attribute-token graph train skip-gram token vectors (see vectors.py); a record
is the weighted sum of its tokens' vectors, once for its title and once for title and authors. Multi-table
hyperplane hashing blocks: records meet if a bucket of any table agrees, the probing side also trying the buckets
beyond its least certain planes, and if their 128-bit sketches are near. The pairs are reranked exactly - title by
edit distance and word by word, authors by surname, dates by year, parts of a series by number - and the cosine of
each pair is turned into a confidence by a logistic curve fitted to pairs whose authors and years, which the title's
cosine knows nothing of, agree or disagree.

Scale: records are reduced to distinct profiles before hashing, so a title or work that fills a third of all rows is
hashed once; bits per table follow the number of profiles, so the bucket size stays level; buckets are joined, never
multiplied out in one task; the probing side's profiles are broadcast while they weigh BROADCAST_BYTES at most and
joined by shuffle beyond. The model is fitted on all profiles, shard by shard, and its token counts, the mean vectors
and the curve come from all of them: the curve's pairs are counted in cells of their cosine, CELLS to one. What reaches
the driver are the vectors of tokens that two profiles hold, one sum of each task and the cells. Each step's shuffle
files are removed once its result is written or collected, so the disk holds one step's shuffles, not all of them.

Null or empty titles match nothing. Null authors or dates are missing evidence and contradict nothing; then the
titles must agree word for word but for misspellings and words left out. Repeated rows all count.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.llm.history import part_number
from tessella.llm.survivors import bare_doi
from tessella.llm.vectors import DIMS, TRAINED, Hyperplanes, Model, train_shard
from tessella.operators.timestamps import ZoneTables, utc_micros
from tessella.session import durable, shuffles_freed

SHARD = 8192  # profiles trained on together, by the hash of their ids
FIXED = 1 << 20  # sums are kept in these parts of one
CELLS = 10_000  # of a cosine between 0 and 1, for the curve
SKETCH_DISTANCE = 38  # of 128 bits
BROADCAST_BYTES = 32 << 20
SHORTEST, PLAIN = 12, 18  # letters a title must have to stand for a longer one that holds it, with like authors and without any
LEAD = r"(?s)^(.+?(?:[:?!;.][\s_]|[\s_][-\u2013\u2014]+[\s_]))"  # a title up to its subtitle
HASH_SCHEMA = "pid bigint, bucket bigint, s0 bigint, s1 bigint, year smallint"


def effort(bits: int) -> tuple[int, int, int]:
    """(tables of titles, tables of titles with authors, probed planes) for tables of so many bits.

    More bits part like records more often. Tables and probes grow with them, so that the share of like records which
    meet stays where it is (a test measures it from 8 to 32 bits).
    """
    more = max(0, bits - 11)
    return 5 + more // 4, 3 + more // 4, 2 + more // 3


def _folding() -> tuple[str, str]:
    """Latin letters with accents and the plain letters they are built on."""
    pairs = {"ø": "o", "Ø": "O", "ß": "s", "đ": "d", "ð": "d", "ł": "l", "þ": "t", "ı": "i", "æ": "a", "œ": "o"}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def plain_words(text: Column) -> Column:
    """Lower-case words of plain letters and digits, one blank between them."""
    accents, letters = _folding()
    marks = F.regexp_replace(text, r"[\p{M}\p{Cf}'’]+", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(marks, accents, letters)), "[^a-z0-9]+", " "))


def _last_name(name: Column) -> Column:
    """The surname of ``Given M. Surname``, ``Surname, Given`` or ``Surname GM``."""
    tidy = F.trim(F.regexp_replace(name, r"(^|\s)\p{L}{1,2}\.?(?=\s|$)", " "))
    return F.when(name.contains(","), F.substring_index(name, ",", 1)).otherwise(F.substring_index(tidy, " ", -1))


def _rows(rows: DataFrame, authors: Column, names: Column) -> DataFrame:
    """Rows with title, authors and micros -> (id, pid, title, head, tail, people, names, year, part), written once."""
    people = plain_words(authors)
    lead = rows.select("id", "title", F.regexp_extract("title", LEAD, 1).alias("lead"), people.alias("people"), names.alias("names"), F.year(F.timestamp_micros("micros")).alias("year"))
    words = lead.select("*", plain_words(F.col("title")).alias("plain"), F.when(F.col("lead") != "", plain_words(F.col("lead"))).alias("head"))
    words = words.withColumn("tail", F.when(F.startswith("plain", "head"), F.trim(F.substring("plain", F.length("head") + 1, F.length("plain")))))
    long = lambda c: F.when(F.length(F.replace(F.col(c), F.lit(" "))) >= SHORTEST, F.col(c)).alias(c)
    shaped = durable(words.select("id", F.col("plain").alias("title"), long("head"), long("tail"), "people", "names", "year", part_number(F.col("title")).alias("part")))
    given = shaped.where("title is not null and title <> ''").withColumn("people", F.nullif("people", F.lit(""))).withColumn("names", F.nullif("names", F.lit("")))
    return given.withColumn("pid", F.xxhash64("title", "people", "year", "part"))


def _distinct(rows: DataFrame) -> DataFrame:
    """The distinct profiles, written once since they are read several times."""
    return durable(rows.groupBy("pid").agg(*[F.max(c).alias(c) for c in ("title", "head", "tail", "people", "names", "year", "part")]))


def _trainer(seed: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches in the order of their shards -> what each token's vectors of the task's shards sum up to."""
        sums: dict[int, np.ndarray] = {}
        held: list[pd.DataFrame] = []

        def train() -> None:
            whole = pd.concat(held)
            records = [[t.split(), p.split() if p else []] for t, p in zip(whole["title"], whole["people"])]
            keys, n, vectors = train_shard(records, int(whole["shard"].iat[0]), seed)
            rows = np.concatenate((n[:, None], np.rint(vectors.astype(np.float64) * n[:, None] * FIXED).astype(np.int64)), 1)
            for key, row in zip(keys.tolist(), rows):
                sums[key] = sums[key] + row if key in sums else row

        for batch in batches:
            for shard, part in batch.groupby("shard", sort=False):
                if held and held[0]["shard"].iat[0] != shard:
                    train()
                    held.clear()
                held.append(part)
        if held:
            train()
        if sums:
            table = np.stack(list(sums.values()))
            yield pd.DataFrame({"token": np.fromiter(sums, dtype=np.int64), **{f"v{i}": table[:, i] for i in range(table.shape[1])}})

    return run


def _summer(model: Model):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * DIMS, dtype=np.int64)
        for batch in batches:
            titles = [t.split() for t in batch["title"]]
            both = [t + (p.split() if p else []) for t, p in zip(titles, batch["people"])]
            total += np.concatenate([np.rint(model.vectors(lists).astype(np.float64) * FIXED).astype(np.int64).sum(0) for lists in (titles, both)])
        yield pd.DataFrame({"total": [total]})

    return run


def fit_model(profiles: DataFrame, seed: int = 3) -> tuple[Model, np.ndarray, int]:
    """(model, mean title vector and mean title-and-authors vector, number of profiles): all of them from all profiles."""
    n = profiles.count()
    shard = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(max(1, -(-n // SHARD)))).cast("int").alias("shard")
    shards = profiles.select("pid", "title", "people", shard).repartition("shard").sortWithinPartitions("shard", "pid").drop("pid")
    columns = [f"v{i}" for i in range(TRAINED + 1)]
    sums = shards.mapInPandas(_trainer(seed), ", ".join(f"{c} bigint" for c in ("token", *columns)))
    told = sums.groupBy("token").agg(*[F.sum(c).alias(c) for c in columns]).where("v0 >= 2").orderBy("token").toPandas().to_numpy(dtype=np.int64)
    count, trained = told[:, 1], told[:, 2:].astype(np.float64)
    trained *= 0.4 / (np.linalg.norm(trained, axis=1, keepdims=True) + 1e-9)
    weight = np.where(count >= 3, np.minimum(np.log(max(n, 2) / np.maximum(count, 1)), 5.0) ** 2, 25.0)
    model = Model(told[:, 0].copy(), trained.astype(np.float16), weight.astype(np.float32), 25.0)
    totals = profiles.select("title", "people").mapInPandas(_summer(model), "total array<bigint>").collect() if n else []
    means = np.sum([r[0] for r in totals], axis=0, dtype=np.int64).reshape(2, DIMS) / FIXED / n if n else np.zeros((2, DIMS))
    return model, means.astype(np.float32), n


def _unit(v: np.ndarray, mean: np.ndarray) -> np.ndarray:
    v = v - mean
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)


def _hasher(model: Model, means: np.ndarray, bits: int, probe: bool):  # noqa: ANN202
    n_title, n_both, flips = effort(bits)
    by_title, by_both = Hyperplanes(n_title, bits, flips, 23), Hyperplanes(n_both, bits, flips, 29)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            titles = [t.split() for t in batch["title"]]
            both = [t + (p.split() if p else []) for t, p in zip(titles, batch["people"])]
            every, wholes = np.arange(len(batch)), [(0, by_title, titles), (1, by_both, both)]
            parts = [(kind, planes, lists, every) for kind, planes, lists in wholes]
            for name in () if probe else ("head", "tail"):  # a list may have left out the subtitle or what stands before it
                have = np.flatnonzero(batch[name].notna().to_numpy())
                if len(have):
                    parts.append((0, by_title, [batch[name].iat[i].split() for i in have], have))
            for kind, planes, lists, rows in parts:
                v = _unit(model.vectors(lists), means[kind])
                keys, sketch = (planes.probes(v) if probe else planes.keys(v)) + (kind << 50), planes.sketch(v)
                keys = keys if rows is every else keys[:, : -(-n_title * 3 // 5)]  # pieces go into three of five tables
                at = np.repeat(np.arange(len(v)), keys.shape[1])
                of = rows[at]
                yield pd.DataFrame({"pid": batch["pid"].to_numpy()[of], "bucket": keys.ravel(), "s0": sketch[at, 0], "s1": sketch[at, 1], "year": batch["year"].astype("Int16").array[of]})

    return run


def _profiles(profiles: DataFrame, side: str) -> DataFrame:
    flat = profiles.withColumn("flat", F.replace("title", F.lit(" "), F.lit("")))
    return flat.select(*[F.col(c).alias(f"{c}_{side}") for c in ("pid", "title", "people", "names", "year", "part", "flat")])


def _cosine(model: Model, mean: np.ndarray):  # noqa: ANN202
    @F.pandas_udf(DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (_unit(model.vectors([t.split() for t in s]), mean) for s in (a, b))
        return pd.Series(np.einsum("nd,nd->n", x, y).astype(float))

    return cosine


def _near(a: Column, b: Column) -> Column:
    """Whether two words are the same but for a misspelling."""
    return F.levenshtein(a, b) <= F.greatest(F.lit(1), F.least(F.lit(2), (F.length(a) / 4).cast("int")))


def _years_allow() -> Column:
    """Years that are unknown or at most one apart: no rule accepts any other."""
    return F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) <= 1, F.lit(True))


def _features(pairs: DataFrame) -> DataFrame:
    """Exact evidence of pairs with title, people, names, year and part of sides a and b."""
    ta, tb = F.col("flat_a"), F.col("flat_b")
    least, most = F.least(F.length(ta), F.length(tb)), F.greatest(F.length(ta), F.length(tb))
    contained = (least >= SHORTEST) & (F.contains(ta, tb) | F.contains(tb, ta))
    # what no rule accepts goes first: parts of a series that differ, and titles that are less than four fifths alike
    # without a surname in common, letter for letter, as the rules ask for it
    sifted = pairs.where(F.coalesce(F.col("part_a") == F.col("part_b"), F.lit(True))).where((least >= most * 0.6) | contained)
    named, there = F.split("names_a", " "), F.split("people_b", " ")
    overlap = F.coalesce(F.arrays_overlap(named, there), F.lit(False))
    edits = F.levenshtein(ta, tb)
    close = edits <= most * 0.2
    for n in (24, 18, 12):  # looking along a band, no wider than the edits allowed; it says -1 beyond
        few = F.levenshtein(ta, tb, n)
        close = F.when(most <= n * 5, (few >= 0) & (few <= most * 0.2)).otherwise(close)
    alike = F.when(most - least <= most * 0.4, F.when(overlap, edits <= most * 0.4))
    kept = sifted.where(contained | close | alike)
    out = kept.withColumn("alike", 1 - edits / most).withColumn("overlap", overlap).withColumn("contained", contained)
    wa, wb = F.split("title_a", " "), F.split("title_b", " ")
    lone = lambda x, y: F.filter(F.array_except(x, y), lambda w: F.length(w) >= 4)
    la, lb = lone(wa, wb), lone(wb, wa)
    strange = F.size(F.filter(lb, lambda w: ~F.exists(la, lambda x: _near(w, x)) & ~ta.contains(w)))
    unmatched = F.size(F.filter(la, lambda w: ~F.exists(lb, lambda x: _near(w, x)) & ~tb.contains(w)))
    alone = F.col("names_a").isNull() | F.col("people_b").isNull()  # only then are the words asked about
    return out.withColumn("least", least).withColumn("strange", F.when(alone, strange)).withColumn("unmatched", F.when(alone, unmatched)).withColumn("words", F.least(F.size(wa), F.size(wb)))


def _named_in(there: Column):  # noqa: ANN202
    """Whether a surname stands among words, up to a misspelling."""
    return lambda s: F.array_contains(there, s) | F.exists(there, lambda t: (F.length(s) >= 5) & (F.levenshtein(s, t, 2) >= 0))


def _people(pairs: DataFrame) -> DataFrame:
    """``common``: surnames of a that b's authors name, null if either is missing; ``alike_people``: 1 if half of them."""
    named = F.split("names_a", " ")
    there = F.split("people_b", " ")
    common = F.when(F.col("names_a").isNotNull() & F.col("people_b").isNotNull(), F.size(F.filter(named, _named_in(there))))
    some = F.col("people_b").rlike(r"\bet [a-z]{1,3}$|\b[a-z]{1,3} al$|\bothers$|\bu a$") | (F.col("common") * 2 >= F.size(named))
    return pairs.withColumn("common", common).withColumn("alike_people", F.coalesce(((F.col("common") > 0) & some).cast("int"), F.lit(0)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve for values that stand n times with y of them true, by Newton's method
    with a little shrinkage."""
    w = np.zeros(2)
    if len(x) and 0 < y.sum() < n.sum():
        a = np.stack((x, np.ones_like(x)), 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = a.T @ (a * (n * p * (1 - p))[:, None]) + np.eye(2) * 1e-2
            w = w + np.linalg.solve(h, a.T @ (y - n * p) - 1e-2 * w)
        return float(w[0]), float(w[1])
    return 12.0, -8.0


def match_works(papers: DataFrame, shelf: DataFrame, bits: int | None = None, confidence: bool = True) -> DataFrame:
    """(paper_id, shelf_id, cosine, confidence): rows of ``papers`` and ``shelf`` that are the same work.

    Without ``confidence`` the ids alone: the rules decide, and no curve is fitted.

    ``papers``: paper_id, title, authors (array), doi, published_date. ``shelf``: shelf_id, title, authors (text),
    published_date. ``bits`` per table follow the number of profiles unless given. Rows of ``papers`` that share a DOI are one work: a match of one is a match of all.
    """
    zones = ZoneTables([])
    day = utc_micros(F.col("published_date"), F.lit("UTC"), F.lit("dmy"), zones).alias("micros")
    a_rows = papers.select(F.col("paper_id").alias("id"), "title", "authors", day)
    b_rows = shelf.select(F.col("shelf_id").alias("id"), "title", "authors", day)
    with shuffles_freed(papers.sparkSession):
        a_all = _rows(a_rows, F.array_join("authors", " "), plain_words(F.array_join(F.array_distinct(F.transform("authors", _last_name)), " ")))
        b_all = _rows(b_rows, F.col("authors"), F.lit(None).cast("string"))
        a, b = _distinct(a_all), _distinct(b_all)
        model, means, n = fit_model(a)
        bits = bits or max(4, min(36, round(math.log2(max(n, 2))) - 6))
        ha, hb = (p.select("pid", "title", "head", "tail", "people", "year").mapInPandas(_hasher(model, means, bits, probe), HASH_SCHEMA) for p, probe in ((a, False), (b, True)))
        ha = ha.select(F.col("pid").alias("pid_a"), "bucket", F.col("s0").alias("a0"), F.col("s1").alias("a1"), F.col("year").alias("year_a"))
        hb = hb.select(F.col("pid").alias("pid_b"), "bucket", F.col("s0").alias("b0"), F.col("s1").alias("b1"), F.col("year").alias("year_b"))
        near = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= SKETCH_DISTANCE
        blocked = ha.join(hb, "bucket").where(_years_allow() & near).select("pid_a", "pid_b").repartition("pid_a").distinct()
        sa, sb = _profiles(a, "a"), _profiles(b, "b")
        weight = sb.agg(F.coalesce(F.sum(F.length("title_b") + F.coalesce(F.length("people_b"), F.lit(0)) + 80), F.lit(0))).first()[0]
        pairs = _people(_features(blocked.join(sa, "pid_a").join(F.broadcast(sb) if weight <= BROADCAST_BYTES else sb, "pid_b")))
        # written once, before anything is asked of the features: a filter pushed below them would work them out again
        pairs = durable(pairs.select("pid_a", "pid_b", "title_a", "title_b", "year_a", "year_b", "part_a", "part_b", "alike", "overlap", "contained", "least", "strange", "unmatched", "words", "common", "alike_people"), "pairs")
    known, apart = F.col("common").isNotNull(), F.abs(F.col("year_a") - F.col("year_b"))
    year_ok, same_year = F.coalesce(apart <= 1, F.lit(True)), F.coalesce(apart == 0, F.lit(True))
    part_clash = F.coalesce(F.col("part_a") != F.col("part_b"), F.lit(False))
    half_part = F.col("part_a").isNull() != F.col("part_b").isNull()
    general = (F.col("words") <= 5) & ~F.col("contained") | (F.length("title_a") < 30) & (F.length("title_b") < 30)
    whole = F.col("alike") >= 0.8
    accepted = (
        ~part_clash & (~half_part | same_year)
        & F.when(general, (F.col("alike") >= 0.8) & (F.col("alike_people") == 1) & same_year)
        .when(known, (F.col("alike_people") == 1) & (whole | F.col("contained") | (F.col("alike") >= 0.6) & F.col("overlap")) & year_ok)
        .otherwise((whole | F.col("contained") & (F.col("least") >= PLAIN)) & (F.col("strange") == 0) & ((F.col("unmatched") <= 1) | F.col("contained")) & year_ok)
    )
    if confidence:
        cosine = _cosine(model, means[0])(F.col("title_a"), F.col("title_b")).alias("cosine")
        judged = pairs.where(known).select(F.round(cosine * CELLS).cast("int").alias("cell"), ((F.col("alike_people") == 1) & same_year).cast("int").alias("y"))
        cells = judged.groupBy("cell").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("cell").collect()
        slope, intercept = _logistic(*(np.array(c, dtype=float) for c in (zip(*((r[0] / CELLS, r[1], r[2]) for r in cells)) if cells else ((), (), ()))))
        good = pairs.where(accepted).select("pid_a", "pid_b", cosine).select("pid_a", "pid_b", "cosine", (1 / (1 + F.exp(-(F.col("cosine") * slope + intercept)))).alias("confidence"))
        out = ("cosine", "confidence")
    else:
        good, out = pairs.where(accepted).select("pid_a", "pid_b"), ()
    doi = papers.select(F.col("paper_id").alias("id"), bare_doi(F.col("doi")).alias("doi"))
    members = a_all.select("id", F.col("pid").alias("pid_a")).join(doi, "id", "left").withColumn("work", F.coalesce("doi", F.concat(F.lit("row "), F.col("id").cast("string"))))
    met = good.join(members, "pid_a")
    works = met.groupBy("work", "pid_b").agg(*[F.max(c).alias(c) for c in out]) if out else met.select("work", "pid_b").distinct()
    rows = works.join(doi.select(F.col("id").alias("paper_id"), F.coalesce("doi", F.concat(F.lit("row "), F.col("id").cast("string"))).alias("work")), "work")
    return rows.join(b_all.select(F.col("id").alias("shelf_id"), F.col("pid").alias("pid_b")), "pid_b").select("paper_id", "shelf_id", *out)
