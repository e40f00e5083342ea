"""Landed API payloads (one row a response) to papers and citation nodes.

A row whose payload can't be parsed gives no papers.  Every reader takes a string column
and works by Spark's own JSON and XML functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VENUE_ALIASES, capped_authors, clean_text, strip_doi

PAPER_COLUMNS = ("source", "external_id", "title", "abstract", "authors", "year", "venue", "url", "pdf_url", "citation_count")

_S2_PAPER = (
    "paperId: string, title: string, abstract: string, authors: array<struct<name: string>>, year: int, venue: string, publicationVenue: struct<name: string>, "
    "journal: struct<name: string>, url: string, openAccessPdf: struct<url: string>, citationCount: bigint"
)
_OA_WORK = (
    "id: string, display_name: string, title: string, authorships: array<struct<author: struct<display_name: string>>>, publication_year: int, doi: string, "
    "primary_location: struct<source: struct<display_name: string>, pdf_url: string, landing_page_url: string>, abstract_inverted_index: map<string, array<int>>, cited_by_count: bigint"
)
_S2_NODE = "paperId: string, title: string, year: int, authors: array<struct<name: string>>, citationCount: bigint, externalIds: struct<DOI: string>, url: string"
_ENTRY = (
    "id string, title string, published string, summary string, author array<struct<name: string>>, link array<struct<_href: string, _title: string>>, journal_ref string, comment string, doi string"
)


def _named(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: F.btrim(a)), lambda a: F.coalesce(a, F.lit("")) != "")


def _papers(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.filter(F.col("title").isNotNull()).select(*keep, *PAPER_COLUMNS)


def semantic_scholar_papers(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Papers of search responses; the first of three venue fields that isn't blank; untitled items are left out."""
    keep = [c for c in landed.columns if c != payload]
    items = landed.select(*keep, F.posexplode(F.from_json(payload, f"data array<struct<{_S2_PAPER}>>")["data"]).alias("pos", "i"))
    first = lambda *c: clean_text(F.coalesce(*[F.nullif(x, F.lit("")) for x in c]))
    rows = items.select(
        *keep, "pos", F.lit("semantic_scholar").alias("source"), F.col("i.paperId").alias("external_id"), clean_text(F.col("i.title")).alias("title"), clean_text(F.col("i.abstract")).alias("abstract"),
        F.coalesce(_named(F.col("i.authors.name")), F.array().cast("array<string>")).alias("authors"), F.col("i.year").alias("year"),
        first(F.col("i.venue"), F.col("i.publicationVenue.name"), F.col("i.journal.name")).alias("venue"), F.col("i.url").alias("url"), F.col("i.openAccessPdf.url").alias("pdf_url"), F.col("i.citationCount").alias("citation_count"),
    )
    return _papers(rows, [*keep, "pos"])


def inverted_abstract(index: Column) -> Column:
    """The text of an inverted index {word: [places]}; of words at one place the last counts."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    placed = F.filter(placed, lambda x: x["p"].isNotNull())
    # Words come in the order of the payload: a place's word is the one that comes last.
    ranked = F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    ordered = F.array_sort(ranked)
    kept = F.filter(ordered, lambda x, i: F.coalesce(F.try_element_at(ordered, i + 2)["p"] != x["p"], F.lit(True)))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: x["w"]), " "))


def openalex_papers(landed: DataFrame, payload: str = "payload") -> DataFrame:
    keep = [c for c in landed.columns if c != payload]
    items = landed.select(*keep, F.posexplode(F.from_json(payload, f"results array<struct<{_OA_WORK}>>")["results"]).alias("pos", "i"))
    place = F.col("i.primary_location")
    rows = items.select(
        *keep, "pos", F.lit("openalex").alias("source"), F.col("i.id").alias("external_id"), clean_text(F.col("i.display_name")).alias("title"), clean_text(inverted_abstract(F.col("i.abstract_inverted_index"))).alias("abstract"),
        F.coalesce(_named(F.transform(F.col("i.authorships"), lambda a: clean_text(a["author"]["display_name"]))), F.array().cast("array<string>")).alias("authors"), F.col("i.publication_year").alias("year"),
        clean_text(place["source"]["display_name"]).alias("venue"), F.coalesce(F.nullif(place["landing_page_url"], F.lit("")), F.col("i.doi")).alias("url"), place["pdf_url"].alias("pdf_url"), F.col("i.cited_by_count").alias("citation_count"),
    )
    return _papers(rows, [*keep, "pos"])


def detected_venue(*texts: Column) -> Column:
    """The first known venue whose alias the texts hold: capitals up to six letters, else a title."""
    hay = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(None).cast("string")
    for name, aliases in reversed(VENUE_ALIASES.items()):
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | F.contains(hay, F.lit(alias))
        out = F.when(hit, name.upper() if len(name) <= 6 else name.title()).otherwise(out)
    return out


def _entries(landed: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row an entry of Atom feeds; prefixes of names are taken off first, so one schema reads them."""
    plain = F.regexp_replace(payload, r"<(/?)(?:arxiv|atom|opensearch):", "<$1")
    each = F.regexp_extract_all(plain, F.lit(r"(?s)(<entry>.*?</entry>|<entry .*?</entry>)"), F.lit(1))
    rows = landed.select(*keep, F.posexplode(each).alias("pos", "entry"))
    return rows.select(*keep, "pos", F.from_xml("entry", _ENTRY, {"rowTag": "entry"}).alias("e")).select(*keep, "pos", "e.*")


def arxiv_papers(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Papers of Atom feeds; the venue is the one that journal reference or comment names, else arXiv."""
    keep = [c for c in landed.columns if c != payload]
    rows = _entries(landed, payload, keep)
    year = F.regexp_extract(F.btrim("published"), r"^(\d{4})", 1)
    pdf = F.try_element_at(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(1))["_href"]
    rows = rows.select(
        *keep, "pos", F.lit("arxiv").alias("source"), F.nullif(F.element_at(F.split(clean_text(F.col("id")), "/"), -1), F.lit("")).alias("external_id"), clean_text(F.col("title")).alias("title"), clean_text(F.col("summary")).alias("abstract"),
        F.coalesce(_named(F.transform("author", lambda a: clean_text(a["name"]))), F.array().cast("array<string>")).alias("authors"), F.nullif(year, F.lit("")).cast("int").alias("year"),
        F.coalesce(detected_venue(F.col("journal_ref"), F.col("comment")), F.lit("arXiv")).alias("venue"), clean_text(F.col("id")).alias("url"), pdf.alias("pdf_url"), F.lit(None).cast("bigint").alias("citation_count"),
    )
    return _papers(rows, [*keep, "pos"])


def arxiv_metadata(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """(title, doi, year) of the first entry of each feed; rows without title and DOI are left out."""
    keep = [c for c in landed.columns if c != payload]
    rows = _entries(landed, payload, keep).filter("pos = 0")
    rows = rows.select(*keep, F.nullif(F.btrim("title"), F.lit("")).alias("title"), F.nullif(F.lower(F.btrim("doi")), F.lit("")).alias("doi"), F.nullif(F.regexp_extract(F.btrim("published"), r"^(\d{4})", 1), F.lit("")).cast("int").alias("year"))
    return rows.filter("title IS NOT NULL OR doi IS NOT NULL")


def first_year(*texts: Column) -> Column:
    """The first 19xx or 20xx of the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")) for t in texts]).cast("int")


def web_papers(results: DataFrame) -> DataFrame:
    """Papers of web-search results (title, url, content, site)."""
    title, content, url = clean_text(F.col("title")), clean_text(F.col("content")), F.col("url")
    rows = results.select(
        F.lit("tavily").alias("source"), url.alias("external_id"), title.alias("title"), content.alias("abstract"), F.array().cast("array<string>").alias("authors"),
        first_year(title, content, url).alias("year"), clean_text(F.col("site")).alias("venue"), url.alias("url"), F.when(F.endswith(url, F.lit(".pdf")), url).alias("pdf_url"), F.lit(None).cast("bigint").alias("citation_count"),
    )
    return _papers(rows, [])


def _node_id(own: Column, doi: Column, title: Column) -> Column:
    return F.coalesce(own, F.concat(F.lit("DOI:"), doi), F.concat(F.lit("TTL:"), F.lower(title)))


def semantic_scholar_nodes(landed: DataFrame, payload: str = "payload", most: int = 200) -> DataFrame:
    """(seed, role, pos, node columns) of detail responses: the paper, its references and its citers, ``most`` of each."""
    got = F.from_json(payload, f"struct<{_S2_NODE}, references: array<struct<{_S2_NODE}>>, citations: array<struct<{_S2_NODE}>>>")
    rows = landed.select(got.alias("p")).filter("p IS NOT NULL")
    fields = [f.split(":")[0].strip() for f in ("paperId", "title", "year", "authors", "citationCount", "externalIds", "url")]
    own = F.struct(*[F.col(f"p.{c}").alias(c) for c in fields])
    several = lambda c, role: F.transform(F.slice(F.coalesce(F.col(f"p.{c}"), F.array()), 1, most), lambda n, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), n.alias("n")))
    one = F.array(F.struct(F.lit("seed").alias("role"), F.lit(0).alias("pos"), own.alias("n")))
    rows = rows.select(F.col("p.paperId").alias("seed"), F.explode(F.concat(one, several("references", "reference"), several("citations", "citer"))).alias("x")).select("seed", "x.role", "x.pos", "x.n")
    doi, title = strip_doi(F.col("n.externalIds.DOI")), F.nullif(F.btrim("n.title"), F.lit(""))
    node = _node_id(F.nullif("n.paperId", F.lit("")), doi, title)
    return rows.filter(node.isNotNull()).select(
        "seed", "role", "pos", node.alias("node"), F.coalesce(title, F.lit("(untitled)")).alias("title"), F.col("n.year").alias("year"), capped_authors(F.col("n.authors.name")).alias("authors"),
        F.col("n.citationCount").alias("citation_count"), doi.alias("doi"), F.col("n.url").alias("url"), F.array(F.lit("semantic_scholar")).alias("sources"),
    )


def openalex_nodes(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """One node a work; its id is OA:, else DOI:, else TTL: and the title."""
    rows = landed.select(F.from_json(payload, f"struct<{_OA_WORK}>").alias("n")).filter("n IS NOT NULL")
    work = F.nullif(F.element_at(F.split("n.id", "/"), -1), F.lit(""))
    doi, title = strip_doi(F.col("n.doi")), F.nullif(F.btrim(F.coalesce(F.nullif("n.display_name", F.lit("")), "n.title")), F.lit(""))
    node = _node_id(F.concat(F.lit("OA:"), work), doi, title)
    return rows.filter(work.isNotNull() | title.isNotNull()).select(
        node.alias("node"), F.coalesce(title, F.lit("(untitled)")).alias("title"), F.col("n.publication_year").alias("year"), capped_authors(F.col("n.authorships.author.display_name")).alias("authors"),
        F.col("n.cited_by_count").alias("citation_count"), doi.alias("doi"), F.col("n.primary_location.landing_page_url").alias("url"), F.array(F.lit("openalex")).alias("sources"),
    )
