"""Deduplicating new batches against all accepted history, at a cost that follows the batch.

Method: content-defined chunking. A record is written as three byte streams - the bare DOI, the surnames with the
publication date, and the folded title - and cut where a rolling hash says so. The index is a persistent table
chunk -> paper with the chunk's bytes, beside one row per paper. A batch's chunks are looked up in it; the shared
bytes of each pair of papers, field by field, give the coverage that decides, an exact check of the fields follows,
and the chunks of the papers that were new are appended. The chunk table lies in folders by the chunk's hash and the
papers in folders by the hash of their root; a batch reads the folders its own hashes fall into, so what it reads is
bounded by its own size times the rows of a folder, however long the history.

Same paper
* both have a DOI: the DOI is covered wholly (and equal);
* else, with surnames and date on both sides: these are covered wholly and the titles are alike (edit distance);
* else (metadata cut off): half of the title is covered, the titles are nearly equal, nothing known contradicts,
  and no second paper fits as well - a title that several papers carry identifies none of them.

Skew: records are first reduced to papers by aggregation on their own evidence, and the table holds a chunk once
per paper, so a paper or title that fills a third of all rows is one row of either side of the join.

Null fields are missing evidence; a record without any (no DOI, no title) is its own paper. Repeated rows are
copies of the first. ``metadata`` may be cut off anywhere; keys may stand in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.chunking import chunk_batch
from tessella.session import durable, scratch_path

DOI, WHO, TITLE = 0, 1, 2
REACH = {DOI: 16, WHO: 12, TITLE: 8}
LIKE, NEARLY_EQUAL, HALF = 0.6, 0.85, 0.5
BARE = "not whole and doi is null and title is not null"
PAPER_SCHEMA = "paper bigint, doi string, names string, day string, whole boolean, title string, part int"
CHUNK_SCHEMA = "paper bigint, field tinyint, chunk bigint, bytes int, size int, lone boolean, bare boolean, batch string"
HELD_CHUNKS = "chunk bigint, field tinyint, paper bigint, root bigint, size int, bare boolean"
CHUNKS_EACH = 1 << 19  # rows of a folder of the chunk table
SAID = ("doi", "names", "day", "title", "part")
LOCAL_EDGES = 100_000  # links of a batch, 16 bytes each, that the driver puts together
BROADCAST_ROWS = 200_000  # chunks or pairs of a batch, some 100 bytes each: what has more rows is joined by shuffle


def doi_letters(text: Column) -> Column:
    """The letters and digits of a DOI however it is punctuated, or null."""
    found = F.regexp_extract(F.replace(F.lower(text), F.lit("%2f"), F.lit("/")), r"(10[^a-z0-9]{1,4}[0-9]{3,9}[^a-z0-9].*)", 1)
    letters = F.regexp_replace(found, "[^a-z0-9]+", "")
    return F.when(F.length(letters) > 6, letters)


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]+", "")


def surname(name: Column) -> Column:
    """The surname of ``Given M. Surname``, ``Surname, Given`` or ``Surname GM``, folded."""
    before = F.substring_index(name, ",", 1)
    long = F.nullif(F.regexp_extract(before, r"(?s).*(?:^|[\s .])([^\s .]{3,})", 1), F.lit(""))
    last = F.coalesce(long, F.regexp_extract(before, r"([^\s .]+)[\s .]*$", 1))
    return folded(F.when(name.contains(","), before).otherwise(last))


def surnames(names: Column) -> Column:
    """The sorted distinct surnames of a list of names in one text; null if there are none."""
    each = F.filter(F.transform(names, surname), lambda s: s.isNotNull() & (s != ""))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(each)), " "), F.lit(""))


# The numerals that parts of a series are counted with.
NUMERALS = ["i 1 one", "ii 2 two", "iii 3 three", "iv 4 four", "v 5 five", "vi 6 six", "vii 7 seven", "viii 8 eight", "ix 9 nine", "x 10 ten", "xi 11", "xii 12"]


def part_number(title: Column) -> Column:
    """The number of the part of a series that a title names, or null."""
    low = F.lower(title)
    said = F.regexp_extract(low, r".*\bpart[^\p{L}\p{N}]+([ivx]+|[0-9]{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)\b", 1)
    number = F.create_map(*[F.lit(x) for n, names in enumerate(NUMERALS, 1) for name in names.split() for x in (name, n)])
    return F.when(low.contains("part"), F.try_element_at(number, said))  # the pattern is slow where it finds nothing


def likeness(a: Column, b: Column) -> Column:
    """1 for equal folded titles, less by the edits between them; one cut off early is alike to the whole."""
    edits = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    return F.when(F.startswith(long, short) & (F.length(short) >= 12), F.greatest(edits, F.lit(LIKE))).otherwise(edits)


def same_part(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def evidence(records: DataFrame, batch: Column) -> DataFrame:
    """(record_id, doi, names, day, title, part, batch) of records with identity, title, doi and metadata."""
    listed = F.regexp_extract("metadata", r'"authors"\s*:\s*\[(.*?)\]', 1)
    names = surnames(F.from_json(F.concat(F.lit("["), listed, F.lit("]")), "array<string>"))
    day = F.regexp_replace(F.regexp_extract("metadata", r'"published_date"\s*:\s*"([^"]*)"', 1), "[^0-9]", "")
    from_identity = F.when(~F.lower("identity").contains("title"), doi_letters(F.col("identity")))
    return records.select(
        F.col("record_id").cast("bigint").alias("record_id"), F.coalesce(from_identity, doi_letters(F.col("doi"))).alias("doi"), names.alias("names"), F.when(F.length(day) >= 8, day).alias("day"),
        F.nullif(folded(F.col("title")), F.lit("")).alias("title"), part_number(F.col("title")).alias("part"), batch.alias("batch"),
    )


def with_key(rows: DataFrame) -> DataFrame:
    """Add the record's own strongest evidence as ``key``: DOI, else surnames and date, else title and surnames.

    ``rows`` is evidence with a column ``batch``; keys count within their batch. Several works can share surnames and
    date. A record whose title is unlike that of the first such record gets a key of its own; such records are put
    together afterwards by their chunks.
    """
    who = F.concat_ws("|", "names", "day")
    keyed = durable(rows, "evidence").withColumn(
        "key",
        F.when(F.col("doi").isNotNull(), F.concat(F.lit("d"), "doi"))
        .when(F.col("names").isNotNull() & F.col("day").isNotNull(), F.concat(F.lit("w"), who))
        .when(F.col("title").isNotNull(), F.concat(F.lit("t"), F.col("title"), F.lit("|"), F.coalesce("names", F.lit("")), F.lit("|"), F.coalesce("day", F.lit(""))))
        .otherwise(F.concat(F.lit("r"), F.col("record_id").cast("string"))),
    )
    is_who = F.col("doi").isNull() & F.col("names").isNotNull() & F.col("day").isNotNull()
    first = keyed.where(is_who & F.col("title").isNotNull()).groupBy("batch", "key").agg(F.min(F.struct("record_id", "title", "part")).alias("first"))
    joined = keyed.where(is_who).join(first, ["batch", "key"], "left")
    same = F.coalesce(likeness(F.col("title"), F.col("first.title")) >= LIKE, F.lit(True)) & same_part(F.col("part"), F.col("first.part"))
    own = F.concat_ws("|", "key", "title", F.col("part").cast("string"))
    return keyed.where(~is_who).unionByName(joined.withColumn("key", F.when(same, F.col("key")).otherwise(own)).drop("first"))


def to_papers(keyed: DataFrame) -> DataFrame:
    """One row per batch and key: the smallest record id as ``paper``, and its fields (the longest title)."""
    longest = F.max(F.when(F.col("title").isNotNull(), F.struct(F.length("title").alias("n"), F.col("title").alias("t")))).getField("t")
    whole = F.max(F.when(F.col("names").isNotNull() & F.col("day").isNotNull(), F.struct(F.col("names").alias("names"), F.col("day").alias("day"))))
    grouped = keyed.groupBy("batch", "key").agg(F.min("record_id").alias("paper"), F.max("doi").alias("doi"), whole.alias("who"), F.max("names").alias("any_names"), F.max("day").alias("any_day"), longest.alias("title"), F.max("part").alias("part"))
    return grouped.select("key", "paper", "doi", F.coalesce("who.names", "any_names").alias("names"), F.coalesce("who.day", "any_day").alias("day"), F.col("who").isNotNull().alias("whole"), "title", "part", "batch")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        paper, lone, bare, group = (batch[c].to_numpy() for c in ("paper", "lone", "bare", "batch"))
        parts = []
        for field, name in ((DOI, "doi"), (WHO, "who"), (TITLE, "title")):
            streams = [s.encode() if s else b"" for s in batch[name]]
            owner, chunk, size = chunk_batch(streams, REACH[field])
            whole = np.array([len(s) for s in streams], dtype=np.int64)
            # a chunk that a stream holds twice counts once, with the bytes of both
            order = np.lexsort((chunk, owner))
            o, c, n = owner[order], chunk[order], size[order]
            first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))) if len(o) else np.empty(0, np.int64)
            at = o[first]
            parts.append(pd.DataFrame({"paper": paper[at], "field": np.int8(field), "chunk": c[first], "bytes": np.add.reduceat(n, first) if len(first) else n, "size": whole[at], "lone": lone[at], "bare": bare[at], "batch": group[at]}))
        yield pd.concat(parts)


def chunk_table(papers: DataFrame) -> DataFrame:
    """The chunks of papers, see CHUNK_SCHEMA; ``size`` is the length of the chunk's whole stream."""
    streams = papers.select("paper", "doi", F.when(F.col("whole"), F.concat_ws("|", "names", "day")).alias("who"), "title", F.col("doi").isNull().alias("lone"), F.expr(BARE).alias("bare"), "batch")
    return streams.mapInPandas(_chunks, CHUNK_SCHEMA)


@dataclass
class Batches:
    """Records cut into papers and chunks, batch by batch, as tables in the shared folder; every record is read once."""

    spark: SparkSession
    path: str

    def read(self, name: str, schema: str, batch: str | None = None) -> DataFrame:
        whole = self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        return whole if batch is None else whole.where(F.col("batch") == batch).drop("batch")

    def papers(self, batch: str) -> DataFrame:
        return self.read("papers", f"key string, {PAPER_SCHEMA}", batch)

    def chunks(self, batch: str | None = None) -> DataFrame:
        return self.read("chunks", CHUNK_SCHEMA.removesuffix(", batch string"), batch)


def prepare(records: DataFrame, batch: Column) -> Batches:
    """The papers and chunks of all batches; ``batch`` (a string) names the batch of a record."""
    spark = records.sparkSession
    out = Batches(spark, scratch_path(spark, "batches"))
    rows = with_key(evidence(records, batch))
    rows.select("record_id", "key", "batch").write.parquet(f"{out.path}/rows")
    to_papers(rows).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{out.path}/papers")
    chunk_table(out.read("papers", f"key string, {PAPER_SCHEMA}")).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{out.path}/chunks")
    return out


@dataclass
class Index:
    """The accepted history as tables in the shared folder: chunk -> paper in folders by the chunk's hash, and papers with
    their roots in folders by the root's hash. A look-up reads only the folders that its hashes fall into.
    """

    spark: SparkSession
    path: str
    chunk_buckets: int = 1
    paper_buckets: int = 1

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark, path, *spark.read.parquet(f"{path}/meta").select("chunk_buckets", "paper_buckets").first())

    def chunk_bucket(self, chunk: Column) -> Column:
        return F.pmod(chunk, F.lit(self.chunk_buckets)).cast("int")

    def paper_bucket(self, root: Column) -> Column:
        return F.pmod(F.xxhash64(root), F.lit(self.paper_buckets)).cast("int")

    def _read(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        whole = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        return (whole if buckets is None else whole.where(F.col("bucket").isin(buckets))).drop("bucket")

    def papers(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read("papers", f"{PAPER_SCHEMA}, root bigint", buckets)

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read("chunks", HELD_CHUNKS, buckets)

    def add(self, papers: DataFrame, chunks: DataFrame) -> None:
        """Append papers with their roots, and those of the chunks that are theirs."""
        held = papers.select(*[F.col(f.split()[0]) for f in f"{PAPER_SCHEMA}, root bigint".split(", ")])
        held.withColumn("bucket", self.paper_bucket(F.col("root"))).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/papers")
        theirs = chunks.join(papers.select("paper", "root"), "paper").select(*[f.split()[0] for f in HELD_CHUNKS.split(", ")])
        theirs.withColumn("bucket", self.chunk_bucket(F.col("chunk"))).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/chunks")


def candidates(own: DataFrame, held: DataFrame | None, small: bool) -> DataFrame:
    """(paper_a, paper_b, root_b, c_doi, c_who, c_title): pairs of papers whose shared bytes cover enough of a field.

    ``own``: chunks of a batch, matched with each other (root_b is null) and with ``held``, chunks of the index. Titles
    are asked about only where one side has nothing else to go by. ``small``: the batch's chunks may be broadcast.
    """
    a = own.select(F.col("paper").alias("paper_a"), "field", "chunk", "bytes", F.col("size").alias("size_a"), F.col("lone").alias("lone_a"), F.col("bare").alias("bare_a"))
    side = lambda c, root: c.select(F.col("paper").alias("paper_b"), root.alias("root_b"), "field", "chunk", F.col("size").alias("size_b"), F.col("bare").alias("bare_b"))
    probing = a.where("lone_a and (field <> 2 or bare_a)")
    shared = (F.broadcast(probing) if small else probing).join(side(own, F.lit(None).cast("bigint")), ["field", "chunk"]).where("paper_a <> paper_b")
    if held is not None:
        asked = a.withColumnRenamed("field", "field_a")  # one whole number as the key of the join is the fastest
        old = side(held, F.col("root")).join(F.broadcast(asked) if small else asked, "chunk").where("field = field_a and (field <> 2 or bare_a or bare_b)")
        shared = shared.unionByName(old.select(*shared.columns))
    part = lambda f: F.sum(F.when(F.col("field") == f, F.col("bytes") / F.least("size_a", "size_b")))
    covered = shared.groupBy("paper_a", "paper_b").agg(F.max("root_b").alias("root_b"), part(DOI).alias("c_doi"), part(WHO).alias("c_who"), part(TITLE).alias("c_title"))
    return covered.where(f"c_doi > 0.999 or c_who > 0.999 or c_title >= {HALF}")


def judge(pairs: DataFrame, own: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """Candidate pairs after the exact check: ``sure`` is true for the same paper, null where nothing but the titles
    speaks for it and nothing known against it; ``bare`` names the paper that has only its title. ``small``: the pairs
    may be broadcast.
    """
    fields = ("doi", "names", "day", "whole", "title", "part")
    a = own.select(F.col("paper").alias("paper_a"), *[F.col(c).alias(f"{c}_a") for c in fields])
    b = known.select(F.col("paper").alias("paper_b"), *[F.col(c).alias(f"{c}_b") for c in fields])
    asked = pairs.join(a, "paper_a")
    both = b.join(F.broadcast(asked) if small else asked, "paper_b").withColumn("alike", likeness(F.col("title_a"), F.col("title_b")))
    two_dois = F.col("doi_a").isNotNull() & F.col("doi_b").isNotNull()
    whole = F.col("whole_a") & F.col("whole_b")
    clash = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    sure = F.when(two_dois, F.col("doi_a") == F.col("doi_b")).when(whole, (F.col("names_a") == F.col("names_b")) & (F.col("day_a") == F.col("day_b")) & F.coalesce(F.col("alike") >= LIKE, F.lit(True)) & same_part(F.col("part_a"), F.col("part_b")))
    judged = both.withColumn("sure", sure).where("coalesce(sure, true)")
    kept = judged.where(F.col("sure") | (F.col("sure").isNull() & (F.col("alike") >= NEARLY_EQUAL) & ~clash("names") & ~clash("day") & ~clash("part")))
    a_bare = ~F.col("whole_a") & F.col("doi_a").isNull()
    return kept.select("paper_a", "paper_b", "root_b", "sure", "alike", a_bare.alias("a_bare"), F.when(a_bare, F.col("paper_a")).otherwise(F.col("paper_b")).alias("bare"), "doi_a", "names_a", "day_a")


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """((node, label), rounds): the smallest node that each node of the edges (x, y) is linked to over any number of
    steps, and the rounds it took. Labels spread to neighbours and jump to their own labels until none changes.
    """
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels, rounds = durable(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels"), 1
    while True:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        uneven = both.join(of("x"), "x").join(of("y"), "y").where("lx > ly")
        if uneven.isEmpty():
            return labels, rounds
        lower = durable(uneven.groupBy(F.col("lx").alias("label")).agg(F.min("ly").alias("to")), "lower")  # whole labels move at once
        for _ in range(2):  # and on to where their new labels move
            lower = lower.join(lower.select(F.col("label").alias("to"), F.col("to").alias("on")), "to", "left").select("label", F.coalesce("on", "to").alias("to"))
        labels, rounds = durable(labels.join(lower, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"), rounds + 1


def linked(edges: DataFrame) -> DataFrame:
    """(node, label) as of ``components``. Up to LOCAL_EDGES edges are linked by the driver, which spares a batch dozens
    of small jobs; more of them are linked by joins.
    """
    few = edges.limit(LOCAL_EDGES + 1).toArrow()
    if few.num_rows > LOCAL_EDGES:
        return components(durable(edges, "edges"))[0]
    least: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (up := least.setdefault(top, top)) != top:
            top = up
        while node != top:
            least[node], node = top, least[node]
        return top

    for x, y in zip(few["x"].to_pylist(), few["y"].to_pylist()):
        a, b = root(x), root(y)
        least[max(a, b)] = min(a, b)
    nodes = list(least)
    table = pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array([root(n) for n in nodes], pa.int64())})
    return edges.sparkSession.createDataFrame(table, "node bigint, label bigint")


def guesses(judged: DataFrame, sure: DataFrame, known: DataFrame) -> DataFrame:
    """(x, y): links of papers that have only their title to the one work that fits best.

    ``sure``: (node, label) of the links beyond doubt; two papers of one label are one work. What any paper of a known
    work says (``known``, with roots) may contradict the link.
    """
    label = lambda c, out: sure.select(F.col("node").alias(c), F.col("label").alias(out))
    open_pairs = judged.where("sure is null").join(label("paper_a", "la"), "paper_a", "left").join(label("paper_b", "lb"), "paper_b", "left")
    rooted = open_pairs.select("*", F.coalesce("la", "paper_a").alias("work_a"), F.coalesce("lb", "root_b", "paper_b").alias("work_b"))
    asked = judged.where("sure is null and root_b is not null").select(F.col("root_b").alias("root")).distinct()
    told = known.join(asked, "root", "left_semi").groupBy(F.col("root").alias("root_b")).agg(*[F.collect_set(c).alias(f"{c}_told") for c in ("doi", "names", "day")])
    other = lambda c: F.coalesce((F.size(f"{c}_told") > 0) & ~F.array_contains(f"{c}_told", F.col(f"{c}_a")), F.lit(False))
    fitting = rooted.join(told, "root_b", "left").where(~other("doi") & ~other("names") & ~other("day"))
    work = F.when(F.col("a_bare"), F.col("work_b")).otherwise(F.col("work_a"))
    best = fitting.withColumn("work", work).groupBy("bare", "work").agg(F.max("alike").alias("alike"), F.min(F.struct("work_a", "work_b")).alias("link"))
    # two works that fit equally well leave the paper alone
    top = best.groupBy("bare").agg(F.max(F.struct("alike", "link")).alias("top"), F.collect_list("alike").alias("all"))
    one = top.where(F.size(F.filter("all", lambda v: v == F.col("top.alike"))) == 1)
    return one.select(F.col("top.link.work_a").alias("x"), F.col("top.link.work_b").alias("y")).where("x <> y")


def _settle(own: DataFrame, own_chunks: DataFrame, index: Index | None, buckets: list[int], small: bool) -> tuple[DataFrame, DataFrame | None]:
    """(papers of a batch with their roots, the papers of the index whose roots were looked at)."""
    pairs = durable(candidates(own_chunks, index.chunks(buckets) if index else None, small), "pairs")
    looked, few = None, False
    if index:
        asked = pairs.agg(F.count("*"), F.collect_set(index.paper_bucket(F.col("root_b")))).first()
        roots, few = pairs.select(F.col("root_b").alias("root")).distinct(), small and asked[0] <= BROADCAST_ROWS
        looked = durable(index.papers(asked[1]).join(F.broadcast(roots) if few else roots, "root", "left_semi"), "looked")
    fields = [f.split()[0] for f in PAPER_SCHEMA.split(", ")]
    known = own.select(*fields, F.lit(None).cast("bigint").alias("root"))
    judged = durable(judge(pairs, own, known if looked is None else known.unionByName(looked.select(*known.columns)), few), "judged")
    sure = linked(judged.where("sure").select(F.col("paper_a").alias("x"), F.coalesce("root_b", "paper_b").alias("y")))
    more = linked(guesses(judged, sure, own.select(*fields, F.lit(None).cast("bigint").alias("root")).limit(0) if looked is None else looked))
    first = own.join(sure.withColumnRenamed("node", "paper"), "paper", "left").withColumn("label", F.coalesce("label", "paper"))
    return first.join(more.select(F.col("node").alias("label"), F.col("label").alias("less")), "label", "left").withColumn("root", F.coalesce("less", "label")).drop("label", "less"), looked


def build_index(history: DataFrame, path: str | None = None, chunks_each: int = CHUNKS_EACH) -> Index:
    """The index of a history, made once. ``chunks_each``: rows that a folder of the chunk table should hold."""
    spark = history.sparkSession
    cut = prepare(history, F.lit("0"))
    own, chunks = cut.papers("0"), cut.chunks("0")
    settled = durable(_settle(own, chunks, None, [], False)[0], "settled")
    folders = lambda n: 1 << max(0, -(-n // chunks_each) - 1).bit_length()
    index = Index(spark, path or scratch_path(spark, "history"), folders(chunks.count()), folders(own.count()))
    spark.range(1).select(F.lit(index.chunk_buckets).alias("chunk_buckets"), F.lit(index.paper_buckets).alias("paper_buckets")).write.parquet(f"{index.path}/meta")
    index.add(settled, chunks)
    return index


def check_batches(index: Index, batches: DataFrame, number: str | None, append: bool = True) -> DataFrame:
    """(original_id, record_id) of batch after batch in the order of ``number``, each against all before it.

    Ids of a batch are higher than all accepted ones. With ``append`` the batch's papers and their chunks join the index
    under their roots, but for those that say nothing that a paper of their root doesn't say already. What reaches the
    driver are the numbers of the batches and of the folders that they fall into.
    """
    name = F.coalesce(F.col(number).cast("string"), F.lit("none")) if number else F.lit("0")
    cut = prepare(batches, name)
    order = [r[0] for r in batches.select(F.col(number).alias("n"), name.alias("name")).distinct().orderBy(F.col("n").asc_nulls_last()).select("name").collect()] if number else ["0"]
    said = cut.chunks().groupBy("batch").agg(F.count("*").alias("n"), F.collect_set(index.chunk_bucket(F.col("chunk"))).alias("buckets")).collect()
    sizes, buckets = {r["batch"]: r["n"] for r in said}, {r["batch"]: r["buckets"] for r in said}
    roots = None
    for batch in order:
        own, chunks = cut.papers(batch), cut.chunks(batch)
        small = sizes.get(batch, 0) <= BROADCAST_ROWS
        settled, looked = _settle(own, chunks, index, buckets.get(batch, []), small)
        if append:
            same = reduce(lambda a, c: a & F.col(f"new.{c}").eqNullSafe(F.col(f"held.{c}")), SAID, F.col("new.root") == F.col("held.root"))
            told = looked.groupBy("root", *SAID).agg(F.lit(True).alias("told"))
            settled = settled.alias("new").join(told.alias("held"), same, "left").select("new.*", "told")
        settled = durable(settled, "settled")
        part = settled.select("key", "root", F.lit(batch).alias("batch"))
        roots = part if roots is None else roots.unionByName(part)
        if append:
            index.add(settled.where("told is null"), chunks)
    rows = cut.read("rows", "record_id bigint, key string")
    if roots is None:
        return rows.limit(0).select(F.col("record_id").alias("original_id"), "record_id")
    return rows.join(roots, ["batch", "key"]).where("record_id <> root").select(F.col("root").alias("original_id"), "record_id")


def check_batch(index: Index, batch: DataFrame, append: bool = True) -> DataFrame:
    """(original_id, record_id): the rows of one batch that repeat a row of the index or an earlier row of the batch."""
    return check_batches(index, batch, None, append)
