"""Queries that land the given tables as API payloads and read them again, and the streams over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import payloads, tables
from ..streaming import jobs
from .catalog import query

_CLEAN = "trim(regexp_replace({}, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))"


def _titled(f) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return f.documents.select("doc_id", "lang", "source", "n_chars", F.substring(first, 1, 200).alias("title"), (2016 + F.col("doc_id") % 10).cast("int").alias("year"))


def _landed(rows: DataFrame, name: str, item) -> DataFrame:
    """One payload for every 50 documents of a language."""
    rows = rows.groupBy("lang", F.floor(F.col("doc_id") / 50).alias("page")).agg(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(item).alias("item")))).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["item"]), ",")
    return rows.select("lang", "page", F.concat(F.lit(f'{{"{name}": ['), body, F.lit("]}")).alias("payload"))


_TITLE = _CLEAN.format("substring(split_part(text, chr(10), 1), 1, 200)")


@query(sql=f"SELECT lang, external_id, title, year, venue, citation_count, authors FROM (SELECT lang, CAST(doc_id AS VARCHAR) AS external_id, {_TITLE} AS title, CAST(2016 + doc_id % 10 AS INT) AS year, CASE doc_id % 3 WHEN 0 THEN 'ICML' WHEN 1 THEN source ELSE 'Journal ' || source END AS venue, n_chars AS citation_count, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS authors FROM documents) WHERE title <> ''")
def semantic_scholar_search(f):
    doc = F.col("doc_id")
    names = F.when(doc % 4 == 0, F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.lit(" ").alias("name")))).otherwise(F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.col("source").alias("name"))))
    item = F.struct(
        doc.cast("string").alias("paperId"), "title", "year", names.alias("authors"), F.when(doc % 3 == 0, "ICML").otherwise("").alias("venue"), F.when(doc % 3 == 1, F.struct(F.col("source").alias("name"))).alias("publicationVenue"),
        F.struct(F.concat(F.lit("Journal "), "source").alias("name")).alias("journal"), F.col("n_chars").alias("citationCount"),
    )
    rows = payloads.semantic_scholar_papers(_landed(_titled(f), "data", item))
    return rows.select("lang", "external_id", "title", "year", "venue", "citation_count", F.size("authors").cast("long").alias("authors"))


@query(sql=f"SELECT lang, external_id, title, abstract, url FROM (SELECT lang, 'https://openalex.org/W' || doc_id AS external_id, {_TITLE} AS title, 'w' || doc_id || ' is the word w' || doc_id AS abstract, CASE WHEN doc_id % 2 = 0 THEN 'https://x.org/' || doc_id ELSE 'https://doi.org/10.1/' || doc_id END AS url FROM documents) WHERE title <> ''")
def openalex_search(f):
    """Abstracts come as inverted indexes."""
    doc = F.col("doc_id").cast("string")
    index = F.map_from_arrays(F.array(F.concat(F.lit("w"), doc), F.lit("is"), F.lit("the"), F.lit("word")), F.array(F.array(F.lit(0), F.lit(4)), F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(3))))
    place = F.when(F.col("doc_id") % 2 == 0, F.struct(F.concat(F.lit("https://x.org/"), doc).alias("landing_page_url")))
    item = F.struct(F.concat(F.lit("https://openalex.org/W"), doc).alias("id"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.concat(F.lit("https://doi.org/10.1/"), doc).alias("doi"), place.alias("primary_location"), index.alias("abstract_inverted_index"))
    return payloads.openalex_papers(_landed(_titled(f), "results", item)).select("lang", "external_id", "title", "abstract", "url")


_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _feed(f) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), doc, F.lit("v1</id><published>"), F.col("year").cast("string"), F.lit("-01-02T00:00:00Z</published><title>Paper\n  number "), doc, F.lit("</title><summary>About "), F.col("source"),
        F.lit("</summary><author><name>Ann Lee</name></author><author><name>B. Ode</name></author><link href=\"http://arxiv.org/pdf/2401."), doc, F.lit("\" title=\"pdf\" rel=\"related\"/><link href=\"http://arxiv.org/abs/2401."), doc,
        F.lit("\" rel=\"alternate\"/><arxiv:comment>"), F.when(F.col("doc_id") % 2 == 0, "Accepted at ICML 2023").otherwise("12 pages"), F.lit("</arxiv:comment><arxiv:doi>10.1/ABC"), doc, F.lit("</arxiv:doi></entry>"),
    )
    rows = _titled(f).groupBy("lang", F.floor(F.col("doc_id") / 50).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    head = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
    return rows.select("lang", "page", F.concat(F.lit(head), "body", F.lit("</feed>")).alias("payload"))


@query(sql="SELECT lang, '2401.' || doc_id || 'v1' AS external_id, 'Paper number ' || doc_id AS title, CAST(2016 + doc_id % 10 AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN 'ICML' ELSE 'arXiv' END AS venue, 'http://arxiv.org/pdf/2401.' || doc_id AS pdf_url, 2 AS authors FROM documents")
def arxiv_search(f):
    rows = payloads.arxiv_papers(_feed(f))
    return rows.select("lang", "external_id", "title", "year", "venue", "pdf_url", F.size("authors").alias("authors"))


@query(sql="SELECT lang, CAST(floor(doc_id / 50) AS BIGINT) AS page, '10.1/abc' || min(doc_id) AS doi, CAST(2016 + min(doc_id) % 10 AS INT) AS year FROM documents GROUP BY lang, floor(doc_id / 50)")
def arxiv_metadata(f):
    """The first entry of each feed."""
    return payloads.arxiv_metadata(_feed(f)).select("lang", "page", "doi", "year")


@query(sql="""
SELECT url AS external_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) AS title, CAST(nullif(regexp_extract(url, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:[^0-9A-Za-z_]|$)', 1), '') AS INT) AS year, CASE WHEN ends_with(url, '.pdf') THEN url END AS pdf_url FROM pages
WHERE trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) <> ''""")
def web_results(f):
    """The given pages as web-search results; the year is looked for in the address."""
    rows = f.pages.select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("site"))
    found = payloads.web_papers(rows).select("external_id", "title", "pdf_url")
    return found.select("external_id", "title", payloads.first_year(F.col("external_id")).alias("year"), "pdf_url")


def _details(f) -> DataFrame:
    title = lambda c: F.concat(F.lit("Title "), c.cast("string"))
    node = lambda c: F.struct(F.when(c % 4 != 0, F.sha2(c.cast("string"), 256)).alias("paperId"), title(c).alias("title"), F.struct(F.when(c % 8 == 0, F.concat(F.lit("https://doi.org/10.1/N"), c.cast("string"))).alias("DOI")).alias("externalIds"))
    refs = f.citation_edges.groupBy("citing").agg(F.transform(F.sort_array(F.collect_list("cited")), node).alias("references"))
    own = f.documents.join(refs, F.col("doc_id") == F.col("citing"), "left")
    return own.select(F.to_json(F.struct(F.sha2(F.col("doc_id").cast("string"), 256).alias("paperId"), title(F.col("doc_id")).alias("title"), "references")).alias("payload"))


@query("citation_edges", sql="SELECT sha256(CAST(doc_id AS VARCHAR)) AS seed, 'seed' AS role, sha256(CAST(doc_id AS VARCHAR)) AS node FROM documents UNION ALL SELECT sha256(CAST(citing AS VARCHAR)), 'reference', CASE WHEN cited % 4 <> 0 THEN sha256(CAST(cited AS VARCHAR)) WHEN cited % 8 = 0 THEN 'DOI:10.1/n' || cited ELSE 'TTL:title ' || cited END FROM citation_edges")
def semantic_scholar_details(f):
    return payloads.semantic_scholar_nodes(_details(f)).select("seed", "role", "node")


@query(sql="SELECT CASE WHEN doc_id % 3 <> 0 THEN 'OA:W' || doc_id WHEN doc_id % 2 = 0 THEN 'DOI:10.1/w' || doc_id ELSE 'TTL:work ' || doc_id END AS node, 'Work ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN '10.1/w' || doc_id END AS doi, 6 AS authors FROM documents")
def openalex_works(f):
    doc = F.col("doc_id").cast("string")
    people = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(F.struct(F.concat(F.lit("Author "), i.cast("string")).alias("display_name")).alias("author")))
    work = F.struct(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://openalex.org/W"), doc)).alias("id"), F.concat(F.lit("Work "), doc).alias("display_name"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/W"), doc)).alias("doi"), people.alias("authorships"))
    rows = payloads.openalex_nodes(f.documents.select(F.to_json(work).alias("payload")))
    return rows.select("node", "title", "doi", F.size("authors").alias("authors"))


@query("search_history", sql="SELECT user_id, topic, count(*) AS n, sum(CASE WHEN search_id % 2 = 0 THEN 7 ELSE 0 END)::BIGINT AS results FROM search_history GROUP BY ALL")
def cleaned_history(f):
    """Old rows name their topic ``query``."""
    even = F.col("search_id") % 2 == 0
    old = f.search_history.select("user_id", F.when(even, F.col("topic")).alias("query"), F.when(~even, F.concat(F.lit(" "), "topic")).alias("topic"), F.when(even, 7).alias("result_count"))
    return tables.cleaned_history(old).groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.sum("results_count").alias("results"))


@query(sql="SELECT conv_id AS report_id, count(*) FILTER (turn % 3 <> 0) AS gaps FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn % 3 <> 0) > 0")
def markdown_reports(f):
    """Turns as gaps of a report; every third is ungrounded and left out."""
    rows = f.conversations.select(F.col("conv_id").alias("report_id"), F.lit("topic").alias("topic"), F.col("turn").alias("pos"), F.lit("A gap").alias("title"), F.lit("x").alias("description"), F.lit("y").alias("direction"), F.lit(0.5).alias("confidence"), F.when(F.col("turn") % 3 == 0, "hallucinated").otherwise("grounded").alias("status"))
    return tables.markdown(rows).select("report_id", F.regexp_count("text", F.lit("## A gap")).cast("long").alias("gaps"))


def _folder(f, name: str) -> str:
    """A new folder for a stream's files, in the shared folder of the cluster."""
    shared = f.spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _timed(rows: DataFrame) -> DataFrame:
    """Times without a zone as times of the session's zone, which watermarks need."""
    return rows.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in rows.dtypes])


def _stream(f, view: str) -> tuple[DataFrame, str]:
    """A derived table written to a folder and read as a stream, a few files a batch."""
    folder = _folder(f, view)
    rows = _timed(getattr(f, view))
    rows.repartition(4).write.parquet(f"{folder}/in")
    return f.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"), folder


def _drained(f, frame: DataFrame, folder: str, mode: str, each=None) -> DataFrame:
    before = f.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    f.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        jobs.drained(frame, f"{folder}/state", f"{folder}/out", mode, each)
    finally:
        f.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return f.spark.read.parquet(f"{folder}/out")


_LATEST = lambda rows, keys: rows.join(rows.groupBy(*keys).agg(F.max("batch").alias("batch")), [*keys, "batch"]).drop("batch")


def _by_week(f, view: str, time: str, make, each=None) -> DataFrame:
    """What an append stream has given once every week of a table has landed, one after the other, and a row much later closes all windows."""
    folder = _folder(f, view)
    rows = _timed(getattr(f, view))
    span = rows.agg(F.min(time).alias("first"), F.max(time).alias("last")).first()
    weeks = max(1, (span["last"] - span["first"]).days // 7 + 1) if span["first"] else 0
    week = F.floor((F.unix_timestamp(time) - F.unix_timestamp(F.lit(span["first"]))) / (7 * 86400)) if weeks else F.lit(0)
    rows.limit(0).write.parquet(f"{folder}/in")
    source = f.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for i in range(weeks):
        rows.filter(week == i).write.mode("append").parquet(f"{folder}/in")
        out = _drained(f, make(source), folder, "append", each)
    closing = rows.limit(1).withColumn(time, F.timestamp_add("DAY", F.lit(30), F.lit(span["last"])))
    closing.write.mode("append").parquet(f"{folder}/in")
    out = _drained(f, make(source), folder, "append", each)
    return out.filter(F.col(out.columns[0]) <= F.lit(span["last"]))


@query("search_history", sql="SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM search_history GROUP BY ALL")
def stream_daily(f):
    """Final days of a stream whose weeks land one after the other."""
    return _by_week(f, "search_history", "created_at", jobs.daily_searches).select("day", "n")


@query("search_history", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY searches DESC, topic) AS rn FROM (SELECT w AS start, topic, count(*) AS searches FROM (
  SELECT topic, unnest(generate_series(date_trunc('day', created_at) - INTERVAL 6 DAY, date_trunc('day', created_at), INTERVAL 1 DAY)) AS w FROM search_history) GROUP BY ALL)) WHERE rn <= 10""")
def stream_trending(f):
    """The ten best topics of every final window, picked batch by batch."""
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("searches"), "topic"))
    rows = _by_week(f, "search_history", "created_at", jobs.trending_windows, jobs.top_of_windows)
    return rows.select("start", "topic", "searches").withColumn("rn", place)


@query("interactions", sql="SELECT user_id, external_id, kind, max(ts) AS ts FROM interactions GROUP BY ALL")
def stream_upsert(f):
    rows, folder = _stream(f, "interactions")
    return _LATEST(_drained(f, jobs.latest_interactions(rows), folder, "update"), ["user_id", "external_id", "kind"])


@query("interactions", sql="""
WITH l AS (SELECT user_id, external_id, max(ts) AS ts FROM interactions GROUP BY ALL)
SELECT user_id, external_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, external_id) AS rn, max(ts) OVER (PARTITION BY user_id) AS last FROM l) WHERE rn <= 1000 AND ts >= last - INTERVAL 21 DAY""")
def stream_seen(f):
    rows, folder = _stream(f, "interactions")
    return _LATEST(_drained(f, jobs.seen_ring(rows, late="60 days"), folder, "update"), ["user_id"]).filter("NOT expired").drop("expired")


@query(sql="SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL")
def stream_quota(f):
    rows, folder = _stream(f, "interactions")
    return _LATEST(_drained(f, jobs.quota_counts(rows, "60 days"), folder, "update"), ["user_id", "day"])


@query("gap_feedback", sql="SELECT user_id, gap_id, arg_max(vote, (updated_at, event_id)) FILTER (vote IS NOT NULL) AS vote, arg_max(pursue, (updated_at, event_id)) AS pursue, max(updated_at) AS updated_at FROM gap_feedback GROUP BY ALL")
def stream_feedback(f):
    rows, folder = _stream(f, "gap_feedback")
    return _LATEST(_drained(f, jobs.feedback_fold(rows), folder, "update"), ["user_id", "gap_id"]).select("user_id", "gap_id", "vote", "pursue", "updated_at")


@query("interactions", sql="SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM interactions)) GROUP BY ALL) GROUP BY user_id")
def stream_sessions(f):
    """Sessions are final when the watermark has passed; a last empty day closes them all."""
    folder = _folder(f, "sessions")
    rows = _timed(f.interactions.select("user_id", "ts"))
    rows.repartition(4).write.parquet(f"{folder}/in")
    last = rows.agg(F.timestamp_add("DAY", F.lit(9), F.max("ts")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts")
    source = f.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    stream = jobs.browsing_sessions(source, "1 day", "1 day")
    jobs.drained(stream, f"{folder}/state", f"{folder}/out", "append")
    last.write.mode("append").parquet(f"{folder}/in")
    jobs.drained(stream, f"{folder}/state", f"{folder}/out", "append")
    return f.spark.read.parquet(f"{folder}/out").drop("batch").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("papers", sql="""
WITH k AS (SELECT pos, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_key FROM papers)
SELECT DISTINCT title_key FROM k WHERE pos % 2 = 1 AND title_key NOT IN (SELECT title_key FROM k WHERE pos % 2 = 0)""")
def stream_unknown_papers(f):
    """Odd papers land as a stream; the even ones are known."""
    folder = _folder(f, "papers")
    rows = f.papers.filter("pos % 2 = 1").select("title", F.timestamp_add("SECOND", F.col("pos").cast("int") % 3600, F.lit("2024-01-01").cast("timestamp")).alias("landed_at"))
    rows.repartition(4).write.parquet(f"{folder}/in")
    source = f.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    jobs.drained(jobs.unknown_papers(source, f.papers.filter("pos % 2 = 0")), f"{folder}/state", f"{folder}/out", "append")
    return f.spark.read.parquet(f"{folder}/out").select("title_key").distinct()


@query("papers", sql="SELECT source || ':' || external_id AS key, source, external_id FROM papers")
def paper_keys(f):
    """Keys of library items, and what they are read back as."""
    rows = f.papers.select(T.paper_key(F.col("source"), F.col("external_id")).alias("key"))
    back = T.split_key(F.col("key"))
    return rows.select("key", back["source"].alias("source"), back["external_id"].alias("external_id"))
