"""Records of eleven literature archives, from each provider's JSON to one schema.

A provider is a table of JSON paths and a few built-in expressions; the registry turns a DataFrame of raw JSON
texts into federated records. Broken JSON gives a record of nulls with the provider's constants. There is no network
here: fetching is the business of whatever writes the raw texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["title", "authors", "doi", "url", "abstract", "source", "published_date", "citation_count", "is_open_access", "is_peer_reviewed", "pdf_url", "relevance_score"]


def _at(path: str) -> Column:
    return F.get_json_object("raw", f"$.{path}")


def _strings(path: str) -> Column:
    return F.from_json(_at(path), "array<string>")


def _named(path: str, field: str) -> Column:
    each = F.from_json(_at(path), "array<map<string,string>>")
    return F.filter(F.transform(each, lambda m: m[field]), lambda n: n.isNotNull() & (n != ""))


def _present(base: str, path: str, tail: str = "") -> Column:
    return F.when(_at(path).isNotNull(), F.concat(F.lit(base), _at(path), F.lit(tail)))


def _inverted(path: str) -> Column:
    """A text from its inverted index, words at equal positions in alphabetic order."""
    from tessella.functions.scalars import words_from_positions

    return F.nullif(words_from_positions(F.from_json(_at(path), "map<string,array<int>>")), F.lit(""))


def _openalex_authors() -> Column:
    each = F.from_json(_at("authorships"), "array<struct<author:struct<display_name:string>>>")
    return F.filter(F.transform(each, lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())


def _doaj_link(pdf: bool) -> Column:
    links = F.from_json(_at("bibjson.link"), "array<struct<type:string,content_type:string,url:string>>")
    is_pdf = lambda x: F.coalesce(x["content_type"] == "application/pdf", F.lit(False))
    return F.try_element_at(F.filter(links, lambda x: (x["type"] == "fulltext") & (is_pdf(x) if pdf else ~is_pdf(x))), F.lit(-1))["url"]


def _doaj_doi() -> Column:
    ids = F.from_json(_at("bibjson.identifier"), "array<struct<type:string,id:string>>")
    return F.try_element_at(F.filter(ids, lambda x: x["type"] == "doi"), F.lit(1))["id"]


def _europe_authors() -> Column:
    each = F.from_json(_at("authorList.author"), "array<struct<firstName:string,lastName:string>>")
    return F.transform(each, lambda a: F.trim(F.concat_ws(" ", a["firstName"], a["lastName"])))


def _common(**given: Column) -> dict[str, Column]:
    base = {"title": F.coalesce(_at("title"), F.lit("")), "authors": _strings("authors"), "doi": _at("doi"), "url": _at("url"), "abstract": _at("abstract"), "published_date": _at("date"), "citation_count": F.lit(0), "is_open_access": F.lit(True), "is_peer_reviewed": F.lit(False), "pdf_url": F.lit(None).cast("string"), "relevance_score": F.lit(0.85)}
    return base | given


def _rxiv(site: str | None) -> dict[str, Column]:
    people = F.when(_at("authors") != "", F.split(_at("authors"), "; "))
    return _common(authors=F.coalesce(people, F.array().cast("array<string>")), url=_present("https://doi.org/", "doi"), pdf_url=_present(f"https://www.{site}.org/content/", "doi", "v1.full.pdf"))


def _flag(path: str, value: str = "true") -> Column:
    return F.coalesce(_at(path) == value, F.lit(False))


def _count(path: str) -> Column:
    return F.coalesce(_at(path).try_cast("int"), F.lit(0))


# The providers' fields: fixed by their interfaces.
PROVIDERS: dict[str, Callable[[], dict[str, Column]]] = {
    "arxiv": lambda: _common(pdf_url=F.replace(_at("url"), F.lit("/abs/"), F.lit("/pdf/")), relevance_score=F.lit(1.0)),
    "pubmed": lambda: _common(url=_present("https://pubmed.ncbi.nlm.nih.gov/", "pubmed_id", "/"), is_open_access=F.lit(False), is_peer_reviewed=F.lit(True), relevance_score=F.lit(0.9)),
    "biorxiv": lambda: _rxiv("biorxiv"),
    "medrxiv": lambda: _rxiv("medrxiv"),
    "chemrxiv": lambda: _common(title=F.coalesce(_at("item.title"), F.lit("")), authors=_named("item.authors", "name"), doi=_at("item.doi"), url=_present("https://doi.org/", "item.doi"), abstract=_at("item.abstract"), published_date=F.left(_at("item.publishedDate"), F.lit(10))),
    "openalex": lambda: _common(authors=_openalex_authors(), doi=F.replace(_at("doi"), F.lit("https://doi.org/"), F.lit("")), url=F.coalesce(_at("doi"), _at("id")), abstract=_inverted("abstract_inverted_index"), published_date=_at("publication_date"), citation_count=_count("cited_by_count"), is_open_access=_flag("open_access.is_oa"), is_peer_reviewed=F.coalesce(_at("type").isin("journal-article", "proceedings-article"), F.lit(False)), pdf_url=F.coalesce(_at("best_oa_location.pdf_url"), _at("best_oa_location.landing_page_url")), relevance_score=F.lit(0.9)),
    "semantic_scholar": lambda: _common(authors=_named("authors", "name"), published_date=_at("year"), citation_count=_count("citationCount"), is_open_access=_flag("isOpenAccess"), is_peer_reviewed=F.coalesce(F.arrays_overlap(_strings("publicationTypes"), F.array(F.lit("JournalArticle"), F.lit("Conference"))), F.lit(False)), pdf_url=_at("openAccessPdf.url"), relevance_score=F.lit(0.9)),
    "core": lambda: _common(authors=F.coalesce(_strings("authors"), F.array().cast("array<string>")), url=F.when(_at("sourceFulltextUrls").isNotNull(), F.coalesce(_at("downloadUrl"), _at("sourceFulltextUrls[0]"))), published_date=_at("publishedDate"), citation_count=_count("citationCount"), pdf_url=_at("downloadUrl"), relevance_score=F.lit(0.8)),
    "doaj": lambda: _common(title=F.coalesce(_at("bibjson.title"), F.lit("")), authors=_named("bibjson.author", "name"), doi=_doaj_doi(), url=F.coalesce(_doaj_link(False), _doaj_link(True)), abstract=_at("bibjson.abstract"), published_date=F.lit(None).cast("string"), is_peer_reviewed=F.lit(True), pdf_url=_doaj_link(True)),
    "ieee": lambda: _common(authors=_named("authors.authors", "full_name"), url=_at("html_url"), published_date=_at("publication_date"), citation_count=_count("citing_paper_count"), is_open_access=_flag("access_type", "OPEN_ACCESS"), is_peer_reviewed=F.lit(True), pdf_url=F.when(_flag("access_type", "OPEN_ACCESS"), _at("pdf_url")), relevance_score=F.when(_flag("access_type", "OPEN_ACCESS"), 0.9).otherwise(0.7)),
    "europe_pmc": lambda: _common(authors=_europe_authors(), url=_present("https://doi.org/", "doi"), abstract=_at("abstractText"), published_date=_at("firstPublicationDate"), citation_count=_count("citedByCount"), is_open_access=_flag("isOpenAccess", "Y"), is_peer_reviewed=F.coalesce(_at("source").isin("MED", "AGR", "CBA"), F.lit(False)), pdf_url=_present("https://europepmc.org/backend/ptpmcrender.fcgi?accid=", "pmcid", "&blobtype=pdf")),
}


def records(raw: DataFrame, provider: str) -> DataFrame:
    """Federated records of one provider's raw JSON texts (column ``raw``); other columns are kept in front."""
    fields = PROVIDERS[provider]() | {"source": F.lit(provider)}
    return raw.select(*[c for c in raw.columns if c != "raw"], *[fields[c].alias(c) for c in RECORD])


def federate(raw: dict[str, DataFrame]) -> DataFrame:
    """All providers' records in one table; an unknown provider raises KeyError."""
    return reduce(lambda a, b: a.unionByName(b), [records(df, name) for name, df in raw.items()])
