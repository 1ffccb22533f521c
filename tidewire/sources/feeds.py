"""Feeds (RSS, Atom, filings), chat messages, and configuration tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_whitespace, strip_html

#: One feed document in a string: items of RSS and RDF, entries of Atom.
_ITEM = "struct<title:string,link:string,guid:string,pubDate:string,description:string>"
_ENTRY = "struct<title:string,id:string,updated:string,published:string,summary:string,link:array<struct<_href:string,_rel:string>>>"
RSS_SCHEMA = f"struct<channel:struct<title:string,item:array<{_ITEM}>>>"
ATOM_SCHEMA = f"struct<title:string,entry:array<{_ENTRY}>>"
_DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")


def feed_time(c: Column) -> Column:
    """RFC 822 or ISO 8601; null if neither, never a guess."""
    fixed = F.regexp_replace(F.regexp_replace(F.trim(c), "\\b(?:GMT|UTC|UT)$", "+0000"), "^[A-Za-z]{3},\\s*", "")
    return F.coalesce(F.try_to_timestamp(fixed, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(c)))


def parse_feed(df: DataFrame, xml: str = "xml", source: str = "source_id") -> DataFrame:
    """One row an item of RSS and Atom documents: source_id, source_post_id, title, text, url, published_at.

    An item without an id has its link, or else a hash of its content.  The text is
    the title, a dash and the summary, without markup.  Malformed documents give
    no rows; undated items keep a null time.
    """
    options = {"mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_"}
    rss = df.where(~F.col(xml).rlike("<feed[\\s>]")).select(source, F.explode(F.from_xml(xml, RSS_SCHEMA, options)["channel"]["item"]).alias("i"))
    rss = rss.select(
        source, F.col("i.guid").alias("_id"), F.col("i.title").alias("title"), F.col("i.link").alias("url"),
        F.col("i.pubDate").alias("_date"), F.col("i.description").alias("_summary"),
    )
    atom = df.where(F.col(xml).rlike("<feed[\\s>]")).select(source, F.explode(F.from_xml(xml, ATOM_SCHEMA, options)["entry"]).alias("e"))
    links = F.filter("e.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    atom = atom.select(
        source, F.col("e.id").alias("_id"), F.col("e.title").alias("title"), F.get(links, F.lit(0))["_href"].alias("url"),
        F.coalesce("e.published", "e.updated").alias("_date"), F.col("e.summary").alias("_summary"),
    )
    rows = rss.unionByName(atom)
    title, summary = strip_html(F.col("title")), strip_html(F.coalesce("_summary", F.lit("")))
    text = F.when((summary == "") | (summary == title), title).otherwise(F.concat_ws(" — ", title, summary))
    rows = rows.withColumn("text", text)
    return rows.select(
        F.col(source).alias("source_id"),
        F.coalesce(F.nullif(F.trim("_id"), F.lit("")), F.nullif(F.trim("url"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("source_post_id"),
        title.alias("title"), "text", F.trim("url").alias("url"), feed_time(F.col("_date")).alias("published_at"),
    )


def summarize_feeds(items: DataFrame, now: Column) -> DataFrame:
    """Items, age of the newest in minutes, and whether times are given: usable, undated or dead."""
    age = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.max("published_at"))) / 60000.0
    rows = items.groupBy("source_id").agg(F.count("source_post_id").alias("n_items"), age.alias("newest_age_minutes"))
    kind = F.when(F.col("n_items") == 0, "dead").when(F.col("newest_age_minutes").isNull(), "undated").otherwise("usable")
    return rows.withColumn("kind", kind)


def fresh_items(items: DataFrame, now: Column, minutes: int, most: int) -> DataFrame:
    """Of each source the newest ``most`` items that are no older than ``minutes``; undated items don't count as new."""
    from tidewire.operators.reports import newest_per_key

    recent = items.where(F.col("published_at") >= now - F.make_dt_interval(mins=F.lit(minutes)))
    return newest_per_key(recent, "source_id", "published_at", most, "source_post_id").drop("rank")


def accession(url: Column) -> Column:
    """A filing's accession number in its address; null without one."""
    return F.nullif(F.regexp_extract(url, "(\\d{10}-\\d{2}-\\d{6})", 1), F.lit(""))


def filing_title(title: Column) -> Column:
    """struct(form, company, cik) of titles like ``8-K - NAME (0001234567) (Filer)``."""
    pattern = "^\\s*(\\S[^-]*?(?:-[^\\s-]+)*?)\\s+-\\s+(.*?)\\s*\\((\\d{10})\\)"
    part = lambda i: F.nullif(F.regexp_extract(title, pattern, i), F.lit(""))
    return F.struct(part(1).alias("form"), part(2).alias("company"), part(3).alias("cik"))


CHAT_SCHEMA = (
    "struct<version:int,id:string,channel_id:string,author:string,content:string,timestamp:string,"
    "embeds:array<struct<title:string,description:string,url:string,timestamp:string,author:string,"
    "fields:array<struct<name:string,value:string>>>>>"
)


def parse_chat(df: DataFrame, payload: str = "payload", most_chars: int = 8000) -> DataFrame:
    """Chat payloads to rows with ``text`` and ``reject_reason`` (null if valid); malformed ones stay, to be looked at."""
    rows = df.withColumn("m", F.from_json(payload, CHAT_SCHEMA, {"mode": "PERMISSIVE"}))

    def of_embed(e: Column) -> Column:
        fields = F.transform(F.coalesce(e["fields"], F.array().cast("array<struct<name:string,value:string>>")), lambda f: F.concat_ws(": ", f["name"], f["value"]))
        return F.array_join(F.filter(F.concat(F.array(e["title"], e["description"]), fields), lambda x: x.isNotNull() & (x != "")), "\n\n")

    embeds = F.transform(F.coalesce("m.embeds", F.array().cast("array<struct<title:string,description:string,url:string,timestamp:string,author:string,fields:array<struct<name:string,value:string>>>>")), of_embed)
    text = F.array_join(F.filter(F.concat(F.array(F.col("m.content")), embeds), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")
    published = F.coalesce(F.try_to_timestamp(F.get(F.col("m.embeds"), F.lit(0))["timestamp"]), F.try_to_timestamp(F.col("m.timestamp")))
    rows = rows.withColumn("text", text).withColumn("published_at", published)
    reason = (
        F.when(F.col("m.id").isNull(), "malformed").when(F.coalesce("m.version", F.lit(1)) != 1, "version")
        .when(F.trim("text") == "", "empty").when(F.length("text") > most_chars, "too_long")
        .when(F.col("published_at") > F.current_timestamp() + F.make_dt_interval(hours=F.lit(1)), "future")
    )
    rows = rows.withColumn("reject_reason", reason)
    return rows.select(F.col("m.id").alias("source_post_id"), F.col("m.channel_id").alias("channel_id"), F.col("m.author").alias("author"), "text", "published_at", "reject_reason")


def allowed(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages of configured (channel_id, authors) only; without authors everyone may post; names compare in lower case without ``#1234``."""
    name = F.regexp_replace(F.lower("author"), "#\\d{1,4}$", "")
    rows = messages.withColumn("_name", name).join(channels.select("channel_id", "authors"), "channel_id")
    return rows.where(F.col("authors").isNull() | (F.size("authors") == 0) | F.array_contains(F.transform("authors", F.lower), F.col("_name"))).drop("_name", "authors")


def read_securities(spark: SparkSession, path: str) -> DataFrame:
    """The security master: comments by #, lists by |, ambiguous and of priority 50 unless said otherwise."""
    rows = spark.read.csv(path, header=True, comment="#", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    parts = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\\|"), lambda x: x != "")
    return rows.select(
        F.upper("ticker").alias("ticker"), "name", parts("aliases").alias("aliases"), "exchange",
        F.coalesce("ambiguity", F.lit("ambiguous")).alias("ambiguity"), parts("indices").alias("indices"), "sector",
        F.coalesce(F.col("priority").try_cast("int"), F.lit(50)).alias("priority"),
    )


def post_text(headline: Column, summary: Column) -> Column:
    return normalize_whitespace(F.concat_ws(" — ", headline, summary))


#: What the items of a current report are about.
FILING_ITEMS = {
    "1.01": "enters material agreement", "1.02": "terminates material agreement", "1.03": "files for bankruptcy",
    "2.01": "completes acquisition or disposition", "2.02": "reports results", "2.03": "takes on material debt",
    "2.04": "debt acceleration triggered", "2.05": "announces restructuring costs", "2.06": "records material impairment",
    "3.01": "receives delisting notice", "4.01": "changes auditor", "4.02": "prior financials not reliable",
    "5.01": "change in control", "5.02": "executive or director change",
}


def describe_filing(company: Column, form: Column, items: Column, title: Column, summary: Column) -> Column:
    """``COMPANY, what; what``; without known items the company and form, without these the title and summary."""
    known = F.create_map(*(F.lit(x) for kv in FILING_ITEMS.items() for x in kv))
    said = F.filter(F.transform(items, lambda i: F.try_element_at(known, i)), lambda x: x.isNotNull())
    company, form = F.nullif(F.trim(company), F.lit("")), F.nullif(F.trim(form), F.lit(""))
    return (
        F.when(company.isNotNull() & (F.size(said) > 0), F.concat(company, F.lit(", "), F.array_join(said, "; ")))
        .when(company.isNotNull() & form.isNotNull(), F.concat(company, F.lit(" files "), form, F.lit(" — "), title))
        .otherwise(F.concat_ws(" — ", title, F.nullif(F.trim(summary), F.lit(""))))
    )


NEWS_SCHEMA = "struct<id:bigint,category:string,datetime:bigint,headline:string,related:string,source:string,summary:string,url:string>"


def news_category(source_id: Column) -> Column:
    """An aggregator source's category, by what follows the colon of its id."""
    suffix = F.lower(F.trim(F.split_part(source_id, F.lit(":"), F.lit(2))))
    return F.when(suffix.isin("forex", "crypto", "merger"), suffix).otherwise("general")


def publisher_org(publisher: Column) -> Column:
    """What different spellings of an outlet share; null without a letter or digit."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(publisher)), "[^a-z0-9]+", ""), F.lit(""))


def parse_news(df: DataFrame, now: Column, minutes: int = 60, payload: str = "payload", source: str = "source_id") -> DataFrame:
    """An aggregator's items (JSON arrays) to posts of their publishers, no older than ``minutes``; items without a headline or id are dropped."""
    rows = df.select(source, F.explode(F.from_json(payload, f"array<{NEWS_SCHEMA}>")).alias("i"))
    at = F.when(F.col("i.datetime") > 0, F.timestamp_seconds("i.datetime"))
    rows = rows.withColumn("published_at", at).where("i.id IS NOT NULL AND trim(i.headline) <> ''")
    rows = rows.where(F.col("published_at").isNull() | (F.col("published_at") >= now.cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))))
    return rows.select(
        F.col(source).alias("source_id"), F.concat(F.lit("news:"), F.col("i.id")).alias("source_post_id"), news_category(F.col(source)).alias("category"),
        post_text(strip_html(F.col("i.headline")), strip_html(F.coalesce("i.summary", F.lit("")))).alias("text"), F.col("i.url").alias("url"),
        F.col("i.source").alias("publisher"), publisher_org(F.col("i.source")).alias("publisher_org"),
        F.filter(F.split(F.coalesce("i.related", F.lit("")), ","), lambda x: x != "").alias("tickers"), "published_at",
    )


def watchlist_feeds(lists: list[DataFrame], known: DataFrame, templates: dict[str, str]) -> DataFrame:
    """A feed row for each ticker of any list and each template (name to address with ``{ticker}``), but for ids that are known."""
    tickers = lists[0].select("ticker")
    for more in lists[1:]:
        tickers = tickers.union(more.select("ticker"))
    tickers = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.lit(a).alias("address")) for n, a in sorted(templates.items()))))
    rows = tickers.select("ticker", each.alias("t")).select(
        F.concat_ws(":", F.lit("rss"), "t.kind", F.lower("ticker")).alias("id"), "ticker", F.col("t.kind").alias("kind"),
        F.replace(F.col("t.address"), F.lit("{ticker}"), F.col("ticker")).alias("url"),
    )
    return rows.join(known.select("id"), "id", "left_anti")
