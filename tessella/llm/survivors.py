"""Best representative of each duplicate group, field by field.

Method: field-by-field survivorship in one aggregation. For every attribute the group takes the maximum of a
composite struct (usable, completeness or trust, time, smaller id, value), so each field can come from another row.
Partial aggregation reduces a DOI that holds a third of all rows before the groups are shuffled.

Usable are: an abstract that is no stand-in and no notice (a text that stands under several DOIs with several titles is a
notice of the site, whatever it says; the versions of one paper share a long title); a web address of the PDF itself; a count that is not negative; a known archive. Truncation
marks and blanks don't count towards completeness. Ties go to the latest retrieval, then to the smallest id. Null
times rank behind all others, and so does an archive of unknown trust. Rows without a DOI take no part; a field
nobody can supply is absent from the result. Repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import durable

# Stand-ins for a missing abstract (folded), and openings of notices and sign-in pages.
STAND_INS = ["", "null", "none", "na", "nan", "nil", "tba", "tbd", "unknown", "missing", "abstract", "summary", "noabstract", "noabstractavailable", "abstractnotavailable", "notavailable", "abstractwithheld", "seefulltext", "seepdf", "seepaper", "fulltext", "abstractunavailable", "noabstractprovided", "abstractnotprovided", "nosummaryavailable", "clicktoread", "comingsoon"]
NOTICES = r"^(access to this (content|article|document)|this (site|website) (sets|uses)|sign in|log in|please (sign|log) in|subscribe|you do not have access|we use cookies|cookies? )"
TRUNCATION = r"(\s*(\.\.\.|…|\[(truncated|\.\.\.|…|more)\]|read more|show more|continue reading)\s*[.…]*)+$"
NOTICE_DOIS = 3
OWN_TITLE = 18  # letters from which on a title names one work
FIELDS = ("abstract", "pdf_url", "citation_count", "source")


def bare_doi(text: Column) -> Column:
    """A DOI in any notation, bare and in lower case, or null."""
    plain = F.regexp_replace(F.lower(text), "%2f", "/")
    found = F.regexp_extract(plain, r"(10\.\d{3,9}\s*/+\s*[^\s\"<>]+)", 1)
    tidy = F.regexp_replace(F.regexp_replace(found, r"\s*/+\s*", "/"), r"[.,;:)\]}'\u201d\u2019]+$", "")
    return F.when(tidy.rlike(r"^10\.\d{3,9}/."), tidy)


def archive_key(source: Column) -> Column:
    """The name of an archive whatever its case, outer blanks and kind of word separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[\s_-]+", "_")


def whole_abstract(text: Column) -> Column:
    """An abstract without outer and repeated blanks and without the mark of a truncation."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " ")), f"(?i){TRUNCATION}", ""))


def _rows(papers: DataFrame, archives: DataFrame, keep: list[str]) -> DataFrame:
    trust = archives.select(archive_key(F.col("source")).alias("__archive"), F.col("trust").cast("int").alias("__trust")).where("__archive is not null").groupBy("__archive").agg(F.min("__trust").alias("__trust"))
    # without titles nothing tells the versions of a paper from notices
    titles = F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "") if "title" in papers.columns else F.lit(None).cast("string")
    rows = papers.select(
        bare_doi(F.col("doi")).alias("doi"), "paper_id", F.col("retrieved_at").cast("timestamp_ntz").alias("at"), archive_key(F.col("source")).alias("__archive"),
        whole_abstract(F.col("abstract")).alias("text"), titles.alias("title"), F.trim("pdf_url").alias("pdf"), F.col("citation_count").alias("count"),
        *[F.col(c).alias(f"v_{c}") for c in keep],
    ).where("doi is not null")
    folded = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    rows = rows.withColumn("own", F.col("text").isNotNull() & ~folded.isin(STAND_INS) & ~F.lower("text").rlike(NOTICES))
    rows = rows.withColumn("digest", F.when(F.col("own"), F.unhex(F.md5(F.lower("text"))))).withColumn("length", F.length("text")).drop("text")
    return rows.join(trust, "__archive", "left")


def survivors(papers: DataFrame, archives: DataFrame, with_values: bool = True, least: int = 2) -> DataFrame:
    """One row per DOI that ``least`` or more rows denote: n_rows and for each field the id of the row that
    supplies it (null if none) and, if asked for, its value.
    """
    rows = durable(_rows(papers, archives, list(FIELDS) if with_values else []), "rows")  # read twice
    shared = rows.where("digest is not null").groupBy("digest", "doi").agg(F.min("title").alias("title")).groupBy("digest").agg(F.count("*").alias("dois"), F.count_distinct("title").alias("titles"), F.min(F.coalesce(F.length("title"), F.lit(0))).alias("shortest"))
    notices = shared.where(f"dois >= {NOTICE_DOIS} and (titles >= {NOTICE_DOIS} or shortest < {OWN_TITLE})").select("digest", F.lit(True).alias("notice"))
    rows = rows.join(notices, "digest", "left").drop("title")
    usable = {
        "abstract": F.col("own") & F.col("notice").isNull(),
        "pdf_url": F.col("pdf").rlike(r"(?i)^https?://[^/\s]+/\S*(\.pdf([?#]\S*)?$|pdf/[^/\s]+)") & ~F.col("pdf").rlike(r"(?i)/(login|signin|sign-in|abs|landing|cookies?|consent)([/?#]|$)"),
        "citation_count": F.col("count") >= 0,
        "source": F.col("__archive").isNotNull() & (F.col("__archive") != ""),
    }
    trust = -F.coalesce("__trust", F.lit(1 << 30))
    first = {"abstract": F.col("length"), "pdf_url": trust, "citation_count": F.lit(0), "source": trust}
    # the value comes last in the struct: it is carried along, and ids being unique it never decides
    best = [F.max(F.when(usable[f], F.struct(first[f].alias("rank"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), (-F.col("paper_id")).alias("id"), *([F.col(f"v_{f}").alias("value")] if with_values else [])))).alias(f) for f in FIELDS]
    groups = rows.groupBy("doi").agg(F.count("*").alias("n_rows"), *best).where(F.col("n_rows") >= least)
    return groups.select("doi", "n_rows", *[(-F.col(f"{f}.id")).alias(f"{f}_from") for f in FIELDS], *([F.col(f"{f}.value").alias(f) for f in FIELDS] if with_values else []))


def suppliers(papers: DataFrame, archives: DataFrame) -> DataFrame:
    """(doi, field_name, paper_id): the row that supplies each field of each group of two or more rows."""
    groups = survivors(papers, archives, with_values=False)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_from").alias("paper_id")) for f in FIELDS]))
    return groups.select("doi", pairs.alias("p")).select("doi", "p.field_name", "p.paper_id").where("paper_id is not null")
