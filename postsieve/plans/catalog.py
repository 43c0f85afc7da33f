"""Every operator as a query over the standard tables.

The tables hold no job postings, so they stand in for them: ``pages`` for captured
pages, ``documents`` for posting texts, ``labels`` for the two flags of a reply,
``events`` for the log of listing pages. Each query reads whole tables.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.text import encode_component
from postsieve.functions.urls import host_of
from postsieve.operators import attempts as calls
from postsieve.operators import capture, dedup, details, links, platforms, replies, scoring, state, stop, visits
from postsieve.operators.keyed import last_per_key, number_rows
from postsieve.plans import crawl, curate, incremental, run
from postsieve.session import configure, materialise, new_dir
from postsieve.sources import current, export, search_plan, store, tables
from postsieve.streaming import frontier as stream_frontiers
from postsieve.streaming import pages as stream_pages
from postsieve.streaming import stop as stream_stop
from postsieve.streaming import store as stream_store
from postsieve.streaming import walls as stream_walls


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_pages(spark, f"{sf}/pages.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    return tables.stream_pages_source(spark, f"{sf}/{name}.parque[t]", _table(spark, sf, name).schema)


def _n(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# Stand-ins ---------------------------------------------------------------------


def _host(url: str = "url") -> Column:
    return host_of(F.col(url))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as listing pages: the host as keyword, the page id as page number."""
    return links.page_links(_pages(spark, sf)).withColumn("host", _host())


def _stored_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a table, for queries that read the links twice but should parse the pages once."""
    return materialise(_listing(spark, sf), "listing")


def _job_pages(pages: DataFrame) -> DataFrame:
    """Result pages of the three platforms: every link of a page made a job link."""
    number = (F.col("page_id") % 3).cast("int")
    url = (
        F.when(number == 0, F.lit("https://www.linkedin.com/jobs/search/?start="))
        .when(number == 1, F.lit("https://www.indeed.com/jobs?start="))
        .otherwise(F.lit("https://www.zhipin.com/web/geek/job?page="))
    )

    def anchor(href: Column, i: Column) -> Column:
        job = ((i + 1) * F.col("page_id") % 97).cast("string")
        plain = F.concat(F.lit('<a class="jcs-JobTitle x" href="/viewjob?w='), F.substring(href, 2, 100000), F.lit('">'))
        click = F.concat(F.lit('<div class="job_seen_beacon"><b><a href="/rc/clk?jk='), job, F.lit('&amp;w=1">'))
        tag = (
            F.when(number == 0, F.concat(F.lit("<a href='/jobs/view/"), job, F.lit("/?ref=x'>")))
            .when((number == 1) & (i % 2 == 0), plain)
            .when(number == 1, F.concat(click, F.lit("job</a></b></div><p><a href='/rc/clk?w=2'>")))
            .otherwise(F.concat(F.lit('<a href="/job_detail/'), job, F.lit('.html?lid=1#a">')))
        )
        return F.concat(tag, F.lit("job</a>"))

    found = links.page_links(pages)
    html = F.concat(F.lit("<body>"), F.array_join(F.transform("links", anchor), " "), F.lit("</body>"))
    return found.select("page_id", F.concat(url, F.col("page_id")).alias("url"), html.alias("html"))


def _job_details(pages: DataFrame) -> DataFrame:
    """Detail pages of the three platforms: article and advert renamed to their elements."""
    number = (F.col("page_id") % 3).cast("int")
    url = (
        F.when(number == 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("page_id"), F.lit("/?a=b")))
        .when(number == 1, F.concat(F.lit("https://www.indeed.com/viewjob?from=x&jk="), F.col("page_id")))
        .otherwise(F.concat(F.lit("https://www.zhipin.com/job_detail/"), F.col("page_id"), F.lit(".html?k=1")))
    )
    body = (
        F.when(number == 0, '<div class="wide jobs-description__content">')
        .when(number == 1, '<div id="jobDescriptionText">')
        .otherwise('<div class="job-sec-text">')
    )
    advert = (
        F.when(number == 0, '<div class="topcard__flavor--bullet">')
        .when(number == 1, '<div data-testid="job-location">')
        .otherwise('<div class="name company-name">')
    )
    html = F.replace("html", F.lit("<article>"), body)
    html = F.replace(html, F.lit("</article>"), F.lit("</div>"))
    html = F.replace(html, F.lit('<div class="ad">'), advert)
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def _walled_url() -> Column:
    suffix = (
        F.when(F.col("page_id") % 11 == 5, F.lit("/uas/login"))
        .when(F.col("page_id") % 13 == 6, F.lit("?next=/checkpoint/1"))
        .when(F.col("page_id") % 17 == 7, F.lit("/Login"))
        .otherwise(F.lit(""))
    )
    return F.concat(F.col("url"), suffix)


def _title() -> Column:
    """The first line of a text."""
    return F.split_part("text", F.lit("\n"), F.lit(1))


def _job_url() -> Column:
    return F.concat(F.lit("https://jobs.example/view/"), F.col("doc_id"), F.lit("/"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).join(_table(spark, sf, "labels"), "doc_id")


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels")
    return _docs(spark, sf).join(labels, "doc_id", "left").select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("seq"),
        _title().alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.when(F.col("n_chars") > 2000, F.concat(F.col("n_chars"), F.lit(' "K"'))).otherwise("").alias("salary"),
        F.array("lang", "source").alias("tech_tags"),
        F.concat(F.lit("needs: "), _title()).alias("requirements"),
        F.col("source"),
        _job_url().alias("job_url"),
        (F.col("quality") == 1).alias("is_ai_engineer"),
        (F.col("toxic") == 0).alias("is_campus_or_intern"),
    )


def _event_pages(events: DataFrame) -> DataFrame:
    """Events as listing pages of a keyword per user."""
    n = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value") % 7).cast("bigint")
    new = F.when(F.col("event_type") == "purchase", F.col("n_links")).otherwise(F.lit(0).cast("bigint"))
    pages = events.select("user_id", F.col("event_id").alias("page_no"), n.alias("n_links"), "event_type")
    return pages.withColumn("n_new", new).withColumn("n_dup", F.col("n_links") - F.col("n_new")).drop("event_type")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply per labelled document, most of them spoiled in one way or another."""
    doc = _labelled(spark, sf)
    kind = F.col("doc_id") % 7

    def flag(on: Column) -> Column:
        return F.when(on, "true").otherwise("false")

    tags = (
        F.when(kind == 3, '["a",null]')
        .when(kind == 4, "[]")
        .otherwise(F.concat(F.lit('["'), F.col("lang"), F.lit('","'), F.col("source"), F.lit('"]')))
    )
    title = F.when(kind == 1, "").when(kind == 2, '"title":5,').otherwise('"title":"t",')
    text = F.concat(
        F.lit('{"is_ai_engineer":'),
        flag(F.col("quality") == 1),
        F.lit(',"is_campus_or_intern":'),
        flag(F.col("toxic") == 0),
        F.lit(","),
        title,
        F.lit('"company":"'),
        F.col("source"),
        F.lit('","location":"'),
        F.col("lang"),
        F.lit('","salary":"","requirements":"r","tech_tags":'),
        tags,
        F.lit("}"),
        F.when(kind == 4, " junk").otherwise(""),
    )
    return doc.select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("seq"),
        "doc_id",
        _job_url().alias("url"),
        F.lit("LinkedIn").alias("platform"),
        F.when(kind == 0, "nope").when(F.col("doc_id") % 5 == 3, None).otherwise(text).alias("reply"),
    )


# Search plan -------------------------------------------------------------------


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as keywords, searched on all platforms."""
    parts = _table(spark, sf, "part").select(
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("platform_idx"),
        F.col("p_partkey").alias("keyword_idx"),
        F.concat("p_name", F.lit(" & co's 实习 (intern)")).alias("keyword"),
    )
    return search_plan.select_platforms(parts, [2, 0, 1])


def expand_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = search_plan.expand_plan(_plan(spark, sf))
    positions = [_n(c).alias(c) for c in ("platform_pos", "platform_idx", "page_no")]
    return plan.select(*positions, "keyword_idx")


def search_urls(spark: SparkSession, sf: str) -> DataFrame:
    plan = search_plan.search_urls(_plan(spark, sf))
    return plan.select(*[_n(c).alias(c) for c in ("platform_idx", "page_no")], "keyword_idx", "search_url")


def url_component(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(encode_component(F.col("text"))).alias("encoded"))


# Pages -------------------------------------------------------------------------


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.link_rows(_listing(spark, sf), ["page_id"])
    return rows.select("page_id", _n(F.col("pos") + 1).alias("ord"), F.col("url").alias("href"))


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of visited job pages in the form in which visits are compared."""
    pages = platforms.with_platform(_job_details(_pages(spark, sf)))
    return pages.select("page_id", capture.canonical_job_url(F.col("url"), F.col("platform")).alias("url"))


def job_links(spark: SparkSession, sf: str) -> DataFrame:
    found = links.extract_links(platforms.with_platform(_job_pages(_pages(spark, sf))))
    return links.link_rows(found, ["page_id", "platform"]).withColumn("pos", _n("pos"))


def detail_text(spark: SparkSession, sf: str) -> DataFrame:
    found = details.extract_detail_text(platforms.with_platform(_job_details(_pages(spark, sf))))
    return found.select("page_id", "platform", "text", "parse_failed")


def job_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Listing and detail pages mixed, told apart by their addresses."""
    pages = _pages(spark, sf)
    found = capture.capture(_job_pages(pages).unionByName(_job_details(pages)))
    return found.select("page_id", "platform", "job_url", "walled", _n(F.size("links")).alias("n_links"), (F.col("text") != "").alias("has_text"))


def platform_of_page(spark: SparkSession, sf: str) -> DataFrame:
    marks = [("blog.", "Blog"), ("m.", "Mobile"), ("example.org", "Org")]
    return platforms.with_platform(_pages(spark, sf), marks).select("page_id", "platform")


def auth_wall_pages(spark: SparkSession, sf: str) -> DataFrame:
    url = _walled_url()
    return _pages(spark, sf).select("page_id", platforms.is_auth_wall(url).alias("walled"))


def skip_walled(spark: SparkSession, sf: str) -> DataFrame:
    visits_ = _pages(spark, sf).select("page_id", _host().alias("host"), _walled_url().alias("url"))
    return platforms.skip_walled_platform(visits_, ["host"], "page_id").select("page_id", "host")


# Stop rule and frontier ----------------------------------------------------------


def _page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.listing_counts(_stored_listing(spark, sf), None, ["host"], "page_id")[0]


def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _page_counts(spark, sf)


def consecutive_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return stop.consecutive_dupes(_page_counts(spark, sf), ["host"], "page_id")


def keyword_stop(spark: SparkSession, sf: str) -> DataFrame:
    return stop.keyword_stop(_page_counts(spark, sf), ["host"], "page_id")


def event_consecutive_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return stop.consecutive_dupes(_event_pages(_table(spark, sf, "events")), ["user_id"])


def event_keyword_stop(spark: SparkSession, sf: str) -> DataFrame:
    return stop.keyword_stop(_event_pages(_table(spark, sf, "events")), ["user_id"])


def resumed_keyword_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the users go on with counters saved before."""
    events = _table(spark, sf, "events")
    user = F.col("user_id")
    saved = events.filter(user % 3 > 0).select(user, (user % 5).alias("consec"), (user % 4).alias("pages")).distinct()
    return stop.keyword_stop(_event_pages(events), ["user_id"], carried=saved)


def frontier(spark: SparkSession, sf: str) -> DataFrame:
    found = crawl.keyword_frontier(_stored_listing(spark, sf), None, ["host"], [], "page_id")
    return found.select("seq", "host", "page_id", "url")


def _run_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as listing pages of a run per language, the host as keyword."""
    return _listing(spark, sf).select(
        F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("run_id"),
        F.lit(0).alias("platform_pos"),
        F.col("host").alias("keyword_idx"),
        F.col("page_id").alias("page_no"),
        "links",
    )


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    found = crawl.crawl_frontier(_run_listing(spark, sf))
    return found.select("run_id", F.col("keyword_idx").alias("host"), F.col("page_no").alias("page_id"), "url", "seq")


def incremental_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The same, from three batches: early keywords, late ones, and pages of two runs that come last."""
    listing, path = _run_listing(spark, sf), new_dir(spark, "frontier")
    late = F.col("run_id").isin("de", "es") & (F.col("page_no") % 7 == 3)
    arrival = F.when(late, 2).when(F.col("keyword_idx") > "m", 1).otherwise(0)
    incremental.init_frontier(listing, path)
    for batch_id in range(3):
        incremental.add_pages(listing.filter(arrival == batch_id), path, batch_id)
    found = incremental.read_frontier(spark, path)
    return found.select("run_id", F.col("keyword_idx").alias("host"), F.col("page_no").alias("page_id"), "url", "seq")


def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders pending, partly shipped ones found, shipped ones done."""
    orders = _table(spark, sf, "orders")
    url = F.concat(F.lit("u"), F.col("o_custkey"), F.lit("-"), F.col("o_orderpriority"))
    orders = orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), url.alias("url"), "o_orderstatus")
    links_ = {s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"}
    return visits.pop_processed(visits.enqueue(links_["O"], links_["P"]), links_["F"]).select("run_id", "seq", "url")


def drop_visited(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page that no Spanish page of any host has."""
    listing = _stored_listing(spark, sf)
    rows = links.link_rows(listing, ["page_id"])
    seen = links.link_rows(listing.filter(F.contains("url", F.lit("/es/"))), ["page_id"])
    return visits.drop_visited(rows, seen, ["url"]).select("page_id", "url")


def visited_union(spark: SparkSession, sf: str) -> DataFrame:
    """Job pages visited, and the jobs that result pages show."""
    shown = links.link_rows(links.extract_links(platforms.with_platform(_job_pages(_pages(spark, sf)))), [])
    return visits.mark_visited(canonical_urls(spark, sf), shown, ["url"])


# Filters and lookups --------------------------------------------------------------


def recent_postings(spark: SparkSession, sf: str) -> DataFrame:
    windows = {"view": 10, "click": 20, "purchase": 5, "signup": 25}
    events = _table(spark, sf, "events").select("event_id", "event_type", "ts")
    kept = platforms.recency_filter(events, dt.datetime(2024, 1, 31), "event_type", "ts", windows)
    return kept.select("event_id", "event_type")


def level_filter(spark: SparkSession, sf: str) -> DataFrame:
    levels = {"F": ["1-URGENT", "2-HIGH"], "O": [], "P": ["5-LOW"]}
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return platforms.seniority_filter(orders, "o_orderstatus", "o_orderpriority", levels)


def active_runs(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select("event_id", F.col("user_id").alias("run_id"), "event_type")
    last = last_per_key(events, ["run_id"], ["event_id"])
    status = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "signup", "idle")
        .otherwise("searching")
    )
    return visits.active_run_filter(events, last.select("run_id", status.alias("status")), ["run_id"])


def attach_source(spark: SparkSession, sf: str) -> DataFrame:
    supplier = _table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    nation = _table(spark, sf, "nation").select("n_nationkey", "n_name")
    return platforms.attach_source(supplier, nation, "n_nationkey").select("s_suppkey", "s_name", "n_name")


# Scoring and replies -----------------------------------------------------------------


def prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text", _job_url().alias("url"))
    return scoring.build_prompt(docs, system=None).select("doc_id", "prompt")


def _verdict(batch: pd.DataFrame) -> pd.Series:
    """Stands for a model: qualifies a prompt by its length, takes the first line as title."""

    def one(text: str) -> str:
        title = text.split("Job Description:\n", 1)[1].split("\n", 1)[0]
        fields = {"title": title, "company": "c", "location": "", "salary": "", "requirements": "r"}
        flags = {"is_ai_engineer": len(text) % 3 > 0, "is_campus_or_intern": True}
        return pd.Series({**flags, **fields, "tech_tags": ["AI"]}).to_json(force_ascii=False)

    return batch["prompt"].map(one)


def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_batch(prompt(spark, sf), lambda batch: "length " + batch["prompt"].str.len().astype(str))
    return scored.select("doc_id", "reply")


def scored_until_target(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(
        F.col("lang").alias("run_id"),
        (F.col("doc_id") + 1).alias("seq"),
        _job_url().alias("url"),
        F.lit("Indeed").alias("platform"),
        "text",
    )
    folder = new_dir(spark, "postings")
    curate.score_in_waves(docs, _verdict, folder, f"{folder}-rejected", target=40, wave=100)
    found = store.read_log(spark, folder)
    return found.select("run_id", (F.col("seq") - 1).alias("seq"), "title", "job_url")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts at a call per user, most of them failures."""
    error = F.when(F.col("event_type") != "purchase", F.col("event_type"))
    reply = F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string"))
    return _table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("at"), reply.alias("reply"), error.alias("error"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """How each call stands at the end, with waits of 1, 2 and 4 days."""
    found = calls.call_states(_attempts(spark, sf), ["user_id"], ["at", "event_id"], first_wait=86_400)
    return found.withColumn("attempts", _n("attempts"))


def due_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A call per customer, those due on the third of January; customers beyond the users were never called."""
    customers = _table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    found = calls.due_calls(customers, _attempts(spark, sf), dt.datetime(2024, 1, 3), ["user_id"], order=["at", "event_id"], first_wait=21_600)
    return found.select("user_id", _n("attempt"))


def reply_content(spark: SparkSession, sf: str) -> DataFrame:
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    body = F.when(F.col("lang") == "es", "busy").otherwise(F.to_json(F.struct(F.array(message).alias("choices"))))
    docs = _docs(spark, sf).select("doc_id", body.alias("body"))
    return tables.reply_content(docs).select("doc_id", F.md5("reply").alias("reply"))


def reply_validation(spark: SparkSession, sf: str) -> DataFrame:
    read = replies.parse_reply_strict(_replies(spark, sf))
    return read.select("doc_id", "status", F.array_join("extraction.tech_tags", "; ").alias("tags"))


def reply_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = replies.to_posting(replies.parse_reply_strict(_replies(spark, sf)))
    return found.withColumn("tech_tags", F.array_join("tech_tags", "; "))


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rejected = replies.rejects(replies.parse_reply_strict(_replies(spark, sf)))
    return rejected.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def replay(spark: SparkSession, sf: str) -> DataFrame:
    rejected = replies.rejects(replies.parse_reply_strict(_replies(spark, sf)))
    return replies.replayable(rejected).select("doc_id", "url")


def qualified_postings(spark: SparkSession, sf: str) -> DataFrame:
    return replies.qualify(_postings(spark, sf)).select("job_url", "title", "company", "location", "source")


def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("doc_id") % 8
    ending = (
        F.when(kind == 0, " AI Engineer, intern")
        .when(kind == 1, " ML engineer; 5+ years")
        .when(kind == 2, " AI Engineer and QA Engineer, 3-5 years")
        .when(kind == 3, " 算法 Algorithm Engineer 校招, 10 years")
        .when(kind == 4, " international sales")
        .when(kind == 5, " NLP engineer 0-2 years")
        .when(kind == 6, " 机器学习工程师, 5年以上经验")
        .when(kind == 7, " AI engineers, at least five years")
        .otherwise("")
    )
    docs = _docs(spark, sf).select("doc_id", F.concat("text", ending).alias("text"))
    return scoring.rule_labels(docs).select("doc_id", "rule_role", "rule_level")


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("seq") % 3
    found = _postings(spark, sf).withColumns(
        {
            "tech_tags": F.when(F.col("location") == "en", F.array().cast("array<string>")).otherwise(F.col("tech_tags")),
            "requirements": F.when(F.col("location") == "de", "").otherwise(F.col("requirements")),
            "title": F.when(kind == 0, "Junior ML Engineer").when(kind == 1, "AI Engineer").otherwise(F.col("title")),
        }
    )
    return replies.quality_checks(found).select(
        "job_url", "no_tags", "no_requirements", F.array_join("filled_tags", "; ").alias("filled_tags")
    )


# Dedup, target, store --------------------------------------------------------------------


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(
        F.col("lang").alias("run_id"), F.col("doc_id").alias("seq"), _title().alias("title"), F.col("lang").alias("company")
    )


def dedup_title_company(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_title_company(_keyed(spark, sf), []).select("seq", "job_key")


def new_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Postings without labels whose title and company no labelled one has."""
    keyed = dedup.with_job_key(_keyed(spark, sf))
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("seq"))
    fresh = dedup.drop_saved_keys(keyed.join(labels, "seq", "left_anti"), keyed.join(labels, "seq", "left_semi"))
    return fresh.select("seq", "job_key")


def target_cut(spark: SparkSession, sf: str) -> DataFrame:
    first = dedup.dedup_title_company(_keyed(spark, sf))
    return dedup.cut_at_target(first, 50).select("run_id", "seq", "job_key")


def curated_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Replies to postings to save: strict reading, first per title and company, target."""
    read = replies.parse_reply_strict(_replies(spark, sf))
    found = replies.to_posting(read, "run_id", "seq")
    return curate.select_new(found, target=20).select("run_id", "seq", "job_key", "job_url")


def next_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What documents without labels add to runs that saved the labelled ones."""
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("seq"))
    keyed = _keyed(spark, sf)
    saved = dedup.dedup_title_company(keyed.join(labels, "seq", "left_semi"))
    found = curate.select_new(keyed.join(labels, "seq", "left_anti"), saved.select("run_id", "job_key"), target=200)
    return found.select("run_id", "seq", "job_key")


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    batch = F.col("event_type") == "purchase"
    return store.upsert_postings(events.filter(~batch), events.filter(batch), "user_id", ("event_id",))


def bucket_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same in three batches over buckets by user, of which the last two rewrite some."""
    events, path = _table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), new_dir(spark, "current")
    current.init_current(events, path, "user_id", 16)
    arrival = F.when(F.col("event_type") != "purchase", 0).when(F.col("user_id") % 3 == 0, 1).otherwise(2)
    for batch_id in range(3):
        current.upsert_batch(events.filter(arrival == batch_id), path, batch_id, ["event_id"])
    return current.read_current(spark, path)


def clear_postings(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_dir(spark, "postings")
    store.append_batch(dedup.with_job_key(_postings(spark, sf)), folder, 0)
    before = store.count_postings(store.read_store(spark, folder)).first()[0]
    store.clear_postings(spark, folder)
    after = store.count_postings(store.read_store(spark, folder))
    return after.select(_n(F.lit(before)).alias("n_before"), F.col("n_postings").alias("n_after"))


def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches saved, the second over the first, and read back by URL."""
    folder = new_dir(spark, "postings")
    first = dedup.with_job_key(_postings(spark, sf))
    store.append_batch(first, folder, 0)
    again = first.filter(F.col("location") == "en").withColumn("salary", F.lit("new"))
    store.append_batch(again, folder, 1)
    return store.read_postings(spark, folder).withColumn("tech_tags", F.array_join("tech_tags", "; "))


def count_postings(spark: SparkSession, sf: str) -> DataFrame:
    return store.count_postings(_docs(spark, sf))


# State, progress, export -------------------------------------------------------------------


def _flat(states: DataFrame) -> DataFrame:
    return states.withColumn("selected_platform_indices", F.array_join("selected_platform_indices", ","))


def _stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("status"),
        F.col("c_nationkey").cast("int").alias("collected"),
    )


def state_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Stored nulls stay; columns the table lacks are filled in."""
    return _flat(tables.with_run_defaults(_stored_runs(spark, sf)))


def merge_run_state(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id"))
    partial = orders.agg(
        F.count(F.lit(1)).cast("int").alias("collected"),
        F.max(F.when(F.col("o_orderstatus") == "F", "done")).alias("status"),
    )
    merged = state.merge_run_state(_stored_runs(spark, sf), partial, F.lit(1700000000000))
    return merged.select("run_id", "status", "target", "collected", "last_updated")


def reset_run_state(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(state.reset_run_state(_stored_runs(spark, sf), F.lit(1700000000000)))


def latest_run_state(spark: SparkSession, sf: str) -> DataFrame:
    log = _table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("last_updated")
    )
    return state.latest_run_state(log)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).groupBy(F.col("source").alias("run_id"))
    return docs.agg(
        F.max(F.when(F.col("lang") == "es", "done").otherwise("analysing")).alias("status"),
        F.lit(40).alias("target"),
        F.count(F.lit(1)).alias("n_visited"),
    )


def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    saved = _labelled(spark, sf).select(F.col("source").alias("run_id"))
    return state.run_progress(saved, _runs(spark, sf))


def _start(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as runs, shipped orders as visited and open ones as pending links."""
    customer = _table(spark, sf, "customer")
    runs = customer.select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "done").otherwise("idle").alias("status"),
        F.col("c_nationkey").alias("collected"),
        F.lit(20).alias("target"),
    )
    orders = _table(spark, sf, "orders")
    url = F.concat(F.lit("u"), F.col("o_custkey"), F.lit("-"), F.col("o_orderpriority"))
    orders = orders.select(F.col("o_custkey").alias("run_id"), url.alias("url"), "o_orderstatus")
    links_ = {s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FO"}
    return runs, links_["F"], links_["O"]


def resume(spark: SparkSession, sf: str) -> DataFrame:
    runs, visited, pending = _start(spark, sf)
    return visits.run_start(runs, visited, pending).select("run_id", "resumed", "status")


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    runs, visited, pending = _start(spark, sf)
    left = visits.resume_pending(visits.run_start(runs, visited, pending), pending, visited)
    return left.select("run_id", "url")


def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv_lines(_postings(spark, sf))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """The exported file, line by line; part files after the first begin with a line break."""
    path = export.export_csv(_postings(spark, sf), new_dir(spark, "export"))
    return spark.read.text(path).filter(F.col("value") != "").select(F.col("value").alias("line"))


# Streams -----------------------------------------------------------------------------------


def stream_capture(spark: SparkSession, sf: str) -> DataFrame:
    """Links of result pages and texts of job pages, both off one stream."""
    pages = _stream(spark, sf, "pages")
    found = stream_pages.stream_capture(_job_pages(pages).unionByName(_job_details(pages)))
    out = new_dir(spark, "captured")
    query = stream_pages.append_to(found.select("page_id", "platform", "job_url", "links", "text"), out, f"{out}-state")
    query.awaitTermination()
    captured = spark.read.parquet(out)
    rows = links.link_rows(captured.filter("job_url is null"), ["page_id", "platform"])
    rows = rows.withColumn("pos", _n("pos")).withColumn("n_text", F.lit(None).cast("bigint"))
    texts = captured.filter("job_url is not null").select("page_id", "platform", _n(F.length("text")).alias("n_text"))
    return rows.unionByName(texts, allowMissingColumns=True)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.page_links(_stream(spark, sf, "pages")).withColumn("host", _host())
    found = stream_pages.stream_dedup(links.link_rows(rows, ["host"]).drop("pos"), ["host", "url"])
    out = new_dir(spark, "links")
    stream_pages.append_to(found, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out)


def stream_stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    found = stream_stop.stream_stop_rule(_event_pages(_stream(spark, sf, "events")), ["user_id"])
    out = new_dir(spark, "stops")
    stream_pages.append_to(found, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out)


def stream_late_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as numbered pages that arrive in any order, over three micro-batches."""
    pages = number_rows(_event_pages(_table(spark, sf, "events")), ["user_id"], ["page_no"], "number")
    pages = pages.select("user_id", F.col("number").alias("page_no"), "n_links", "n_new", F.timestamp_seconds("number").alias("captured_at"))
    folder = new_dir(spark, "shuffled")
    # Dealt out by hash, so that a keyword's pages are spread over all files.
    pages.repartition(3, F.xxhash64("user_id", "page_no")).write.parquet(folder)
    arriving = tables.stream_pages_source(spark, folder, pages.schema, max_files=1)
    found = stream_stop.stream_ordered_stop_rule(arriving, ["user_id"], wait="3650 days")
    out = new_dir(spark, "ordered")
    stream_pages.append_to(found, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out)


def stream_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl frontier of listing pages that arrive in any order, over three micro-batches."""
    listing, folder, path = _run_listing(spark, sf), new_dir(spark, "arriving"), new_dir(spark, "frontier")
    listing.repartition(3, F.xxhash64("run_id", "keyword_idx", "page_no")).write.parquet(folder)
    arriving = tables.stream_pages_source(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    stream_frontiers.stream_frontier(arriving, path, f"{path}-state").awaitTermination()
    found = incremental.read_frontier(spark, path)
    return found.select("run_id", F.col("keyword_idx").alias("host"), F.col("page_no").alias("page_id"), "url", "seq")


def stream_walled(spark: SparkSession, sf: str) -> DataFrame:
    """Visits that arrive in any order, over three micro-batches, cut off at the first wall of their host."""
    visits_ = _pages(spark, sf).select("page_id", _host().alias("host"), _walled_url().alias("url"))
    folder, out = new_dir(spark, "visits"), new_dir(spark, "unwalled")
    visits_.repartition(3, F.xxhash64("page_id")).write.parquet(folder)
    arriving = tables.stream_pages_source(spark, folder, visits_.schema, max_files=1)
    stream_walls.stream_skip_walled(arriving, out, f"{out}-state", ["host"], "page_id").awaitTermination()
    return stream_walls.read_visits(spark, out, visits_.schema, ["host"], "page_id").select("page_id", "host")


def _posted(docs: DataFrame) -> DataFrame:
    texts = {c: F.lit("") for c in ("salary", "requirements", "location")}
    return docs.select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("seq"),
        _title().alias("title"),
        F.col("lang").alias("company"),
        F.array("source").alias("tech_tags"),
        "source",
        _job_url().alias("job_url"),
        *[v.alias(c) for c, v in texts.items()],
    )


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    postings, folder = _posted(_stream(spark, sf, "documents")), new_dir(spark, "postings")
    stream_store.stream_upsert(postings, folder, f"{folder}-state", 50).awaitTermination()
    return store.read_log(spark, folder).select("run_id", "seq", "job_key")


def whole_run(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to stored postings: every link has a detail page, and a reply that its address decides."""
    listing = materialise(_run_listing(spark, sf), "listing")
    details = links.link_rows(listing, []).select("url", F.lit("LinkedIn").alias("platform")).distinct()
    n = F.length("url")
    fields = {"title": F.substring("url", 2, 100_000), "company": F.lit("c"), "location": F.lit(""), "salary": F.lit(""), "requirements": F.lit("r")}
    reply = F.to_json(
        F.struct(
            (n % 3 > 0).alias("is_ai_engineer"),
            F.lit(True).alias("is_campus_or_intern"),
            *[c.alias(k) for k, c in fields.items()],
            F.array(F.lit("t")).alias("tech_tags"),
        )
    )
    replies_ = details.select("url", F.when(n % 5 == 4, "busy").otherwise(reply).alias("reply"))
    folder = new_dir(spark, "postings")
    run.run_captured(listing, details, replies_, folder, f"{folder}-rejected", target=30)
    return store.read_log(spark, folder).select("run_id", "seq", "title", "job_url")


def two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """A stream saves a third of the postings, a batch another, and the stream goes on with the last."""
    keyed, folder = dedup.with_job_key(_posted(_docs(spark, sf))), new_dir(spark, "postings")
    incoming = new_dir(spark, "incoming")
    # More than any run of the tables saves.
    target = 1_000_000_000

    def stream_on(part: int) -> None:
        keyed.filter(F.col("seq") % 3 == part).drop("job_key").write.mode("append").parquet(incoming)
        source = spark.readStream.schema(keyed.drop("job_key").schema).parquet(incoming)
        stream_store.stream_upsert(source, folder, f"{folder}-state", target).awaitTermination()

    stream_on(0)
    batch = keyed.filter(F.col("seq") % 3 == 1).drop("job_key")
    store.append_batch(curate.select_new(batch, store.read_keys(spark, folder), target), folder, 1, "batch")
    stream_on(2)
    return store.read_log(spark, folder).select("run_id", "seq", "job_key")


def captured_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Postings and rejects from replies captured before; each URL has an earlier reply that failed."""
    found = _replies(spark, sf)
    last = found.select("url", "reply", F.lit(2).alias("reply_seq"))
    replies_ = last.unionByName(last.select("url", F.lit("busy").alias("reply"), F.lit(1).alias("reply_seq")))
    postings, rejected = curate.curate(found.drop("reply"), replies_, target=20)
    saved = postings.select("run_id", "seq", "job_url", F.lit("saved").alias("outcome"))
    return saved.unionByName(rejected.select("run_id", "seq", F.col("url").alias("job_url"), F.col("status").alias("outcome")))


def run_state_files(spark: SparkSession, sf: str) -> DataFrame:
    """Run state out of files of two versions: odd runs know a target, which may be null, even ones do not."""
    folder = new_dir(spark, "states")
    runs = _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("status"), F.nullif("c_nationkey", F.lit(3)).alias("target")
    )
    runs.filter("run_id % 2 = 0").drop("target").write.parquet(folder)
    runs.filter("run_id % 2 = 1").write.mode("append").parquet(folder)
    return tables.read_run_state(spark, folder).select("run_id", "status", "target")


def toggle_platform(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("page_id") % 4).cast("int")
    chosen = search_plan.toggle_platform(F.array(*map(F.lit, (0, 1, 2))), number)
    return _table(spark, sf, "pages").select("page_id", F.array_join(chosen, ",").alias("chosen"))


QUERIES = [
    expand_plan,
    search_urls,
    url_component,
    page_links,
    canonical_urls,
    job_links,
    detail_text,
    job_pages,
    platform_of_page,
    auth_wall_pages,
    skip_walled,
    page_counts,
    consecutive_dupes,
    keyword_stop,
    event_consecutive_dupes,
    event_keyword_stop,
    resumed_keyword_stop,
    frontier,
    crawl_frontier,
    incremental_frontier,
    pending_queue,
    drop_visited,
    visited_union,
    recent_postings,
    level_filter,
    active_runs,
    attach_source,
    prompt,
    score_batch,
    scored_until_target,
    attempts,
    due_calls,
    reply_content,
    reply_validation,
    reply_postings,
    quarantine,
    replay,
    qualified_postings,
    rule_labels,
    quality_flags,
    dedup_title_company,
    new_keys,
    target_cut,
    curated_postings,
    next_batch,
    upsert,
    bucket_upsert,
    clear_postings,
    stored_postings,
    count_postings,
    state_defaults,
    merge_run_state,
    reset_run_state,
    latest_run_state,
    run_progress,
    resume,
    resume_pending,
    csv_lines,
    csv_export,
    stream_capture,
    stream_dedup,
    stream_stop_rule,
    stream_late_pages,
    stream_frontier,
    stream_walled,
    stream_upsert,
    whole_run,
    two_writers,
    captured_replies,
    run_state_files,
    toggle_platform,
]


def queries() -> dict:
    def bound(query):
        return lambda spark, sf: query(configure(spark), sf)

    return {q.__name__: bound(q) for q in QUERIES}
