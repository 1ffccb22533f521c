"""The whole way of a post: normalised, compared, classified, scored, and published or rejected with a reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.simhash import simhash64, text_similarity
from tidewire.functions.terms import Matched, few_at_once, with_terms
from tidewire.functions.times import too_old
from tidewire.operators import classify as C
from tidewire.operators import extract as E
from tidewire.operators import score as S
from tidewire.operators.cluster import cluster_posts
from tidewire.operators.dedupe import find_duplicates, prepare
from tidewire.operators.earnings import earnings_headline, with_earnings
from tidewire.operators.impact import assess_impact
from tidewire.sources.shared import written


@dataclass(frozen=True)
class Lexicon:
    """What the classifiers know; all of it is given by the user."""

    categories: Sequence[C.Category] = ()
    noise: Mapping[str, Sequence[str]] = field(default_factory=dict)
    verbs: Sequence[str] = ()
    factual: Sequence[str] = ()
    commentary: Sequence[str] = ()
    high: Sequence[str] = ()
    medium: Sequence[str] = ()
    relevance: Mapping[str, float] = field(default_factory=dict)
    sub_relevance: Mapping[str, float] = field(default_factory=dict)
    securities: Sequence[E.Security] = ()
    #: Canonical name to the forms in which it stands in texts.
    countries: Mapping[str, Sequence[str]] = field(default_factory=dict)
    organizations: Mapping[str, Sequence[str]] = field(default_factory=dict)
    people: Mapping[str, Sequence[str]] = field(default_factory=dict)
    commodities: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: Further evidence for categories beside the names in a post, as columns over what ``extracted`` adds.
    boosts: Mapping[str, Column] = field(default_factory=dict)


def normalize(posts: DataFrame) -> DataFrame:
    """Adds clean_text, headline, body, tokens, fingerprint, language, is_echo to posts with a ``text``.

    An echo is a relayed post without words of its own, or one (with ``quoted_text``)
    whose own words are a copy of what it quotes.
    """
    raw = F.coalesce("text", F.lit(""))
    df = posts.withColumn("clean_text", X.cleaned(raw)).withColumn("_parts", X.headline_and_body(F.col("clean_text"), normalized=True))
    letters = F.length(F.regexp_replace("clean_text", "\\P{L}+", ""))
    latin = F.length(F.regexp_replace("clean_text", "\\P{IsLatin}+", ""))
    # Counted only where there is another letter at all.
    other = F.col("clean_text").rlike("[\\p{L}&&\\P{IsLatin}]")
    df = df.withColumns(
        {
            "headline": F.col("_parts.headline"),
            "body": F.col("_parts.body"),
            "tokens": X.tokenize(F.col("clean_text")),
            "language": F.when(other & ((letters - latin) > 0.3 * F.greatest(letters, F.lit(1))), "non-latin").otherwise("en"),
            "is_echo": raw.rlike("(?i)^\\s*RT\\s+@") & (F.col("clean_text") == ""),
        }
    )
    if "quoted_text" in posts.columns:
        quoted = X.tokenize(F.coalesce("quoted_text", F.lit("")))
        alike = text_similarity(F.col("tokens"), simhash64(F.col("tokens")), quoted, simhash64(quoted)) > 0.9
        copies = (F.coalesce("quoted_text", F.lit("")) != "") & (F.col("clean_text") != "") & alike
        df = df.withColumn("is_echo", F.col("is_echo") | copies)
    return df.withColumn("fingerprint", X.fingerprint(F.col("tokens"))).drop("_parts")


def extracted(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds what a post names: tickers (with evidence), countries, organizations, people, commodities, and figures."""
    given = F.col("provided") if "provided" in df.columns else None
    kinds = ("countries", "organizations", "people", "commodities")
    found = E.extract_all(F.col("clean_text"), lexicon.securities, {kind: getattr(lexicon, kind) for kind in kinds}, given)
    df = few_at_once(df).withColumn("_named", found).withColumns({k: F.col("_named")[k] for k in ("tickers", "figures", *kinds)})
    return df.drop("_named").withColumn("symbols", F.transform("tickers", lambda t: t["ticker"]))


def _has(kind: str) -> Column:
    return F.size(kind) > 0


def searched(df: DataFrame, lexicons: Sequence[Lexicon]) -> tuple[DataFrame, Matched]:
    """Adds which terms of any of the lexicons a post has, and its earnings: each text is read once, however many lexicons judge it."""
    plain = [t for x in lexicons for t in (*C.category_terms(x.categories), *x.high, *x.medium)]
    folded = [t for x in lexicons for t in (*C.noise_terms(x.noise), *x.factual, *x.commentary)]
    df, text = with_terms(df, "clean_text", plain, folded)
    return with_earnings(df, "clean_text", "stated"), text


def classified(df: DataFrame, text: Matched, lexicon: Lexicon) -> DataFrame:
    """Adds verdict, noise, facts, earnings, filing; category is EARNINGS where results are stated, and headline then tells them."""
    tokens, has_figures = F.col("tokens"), _has("figures")
    named = _has("symbols") | _has("organizations") | _has("commodities") | _has("people") | _has("countries")
    boosts = C.entity_boosts(*(F.col(c) for c in ("tickers", "countries", "organizations", "people", "commodities")))
    boosts |= {c: boosts[c] + more if c in boosts else more for c, more in lexicon.boosts.items()}
    df = df.withColumn("verdict", C.classify_category(text, tokens, lexicon.categories, named, F.col("manual"), boosts, source_category=F.col("source_category")))
    df = df.withColumn("noise", C.classify_noise(text, tokens, lexicon.noise, F.col("is_echo"), F.col("quality_score"), F.col("strict"), F.col("manual")))
    df = df.withColumn("facts", C.classify_factuality(text, tokens, has_figures, lexicon.verbs, lexicon.factual, lexicon.commentary, F.col("official")))
    df = df.withColumns({"n_high": X.count_terms(text, lexicon.high), "n_medium": X.count_terms(text, lexicon.medium)})
    df = df.withColumn("earnings", F.when(F.col("verdict").isNotNull(), F.col("stated")))
    states = F.col("earnings").isNotNull()
    df = df.withColumn("category", F.when(states, "EARNINGS").otherwise(F.col("verdict.category")))
    df = df.withColumn("said", F.when(states, earnings_headline(F.col("earnings"), F.get("symbols", F.lit(0)), F.col("headline"))).otherwise(F.col("headline")))
    return df.withColumn("filing", F.when(F.col("form").isNotNull(), C.filing_materiality(F.col("form"), F.col("items"), F.coalesce("title", "headline"))))


def scored(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``fixed`` (the weighted parts that don't hang on the cluster) and ``credit`` (credibility before corroboration)."""
    category = F.col("category")
    names_asset = _has("symbols") | _has("commodities")
    surprise = F.coalesce("earnings.eps_surprise", "earnings.revenue_surprise")
    parts = {
        "source_quality": S.source_quality(F.col("quality_score"), F.col("noise_score")),
        "market_relevance": S.market_relevance(category, lexicon.relevance or {"": 60.0}, F.col("verdict.subcategory"), lexicon.sub_relevance, names_asset),
        "magnitude": S.magnitude(F.col("n_high"), F.col("n_medium"), F.col("figures"), F.col("filing"), surprise),
        "asset_exposure": S.asset_exposure(F.col("exposure"), category, _has("commodities"), _has("countries")),
    }
    fixed = sum((F.coalesce(c, F.lit(0.0)) * S.WEIGHTS[name] for name, c in parts.items()), F.lit(0.0))
    factual = F.when(F.col("facts.verdict") == "FACTUAL_NEWS", F.col("facts.confidence") * 12).otherwise(-25.0)
    credit = F.when(F.col("official"), 95.0).otherwise(60 + F.col("quality_score") * 0.25) + factual - F.col("noise.confidence") * 5
    return df.withColumns({"fixed": fixed, "credit": F.coalesce(credit, F.lit(0.0))})


#: What ``assessed`` reads of a prepared post.
PREPARED = (
    "id", "source_id", "ts", "published_at", "form", "items", "title", "cik", "clean_text", "headline", "tokens", "fingerprint", "is_echo",
    "enabled", "source_type", "quality_score", "noise_score", "source_category", "manual", "strict", "official",
    "tickers", "figures", "countries", "organizations", "people", "commodities", "symbols",
)
#: What ``judged`` reads of it.
KEPT = (
    "id", "source_id", "ts", "published_at", "cik", "fingerprint", "enabled", "manual", "strict", "symbols", "countries", "organizations", "people",
    "commodities", "has_mover", "empty", "sure", "hashed",
)


def prepared(posts: DataFrame, sources: DataFrame, lexicon: Lexicon) -> DataFrame:
    """What needs a post and its source only, and no category: normalised, with what it names and what is compared of it.

    Of the lexicon only securities and names are used, so posts that are judged by several
    lexicons which have these in common are prepared once.  Nothing of it is written:
    each step is a projection of its own, or has a Python function between it and the next.
    """
    # Written, so that Spark knows how small it is: joined by hash, all posts of a source would be one task's.
    known = written(
        sources.select(
            "source_id", "enabled", "source_type", "quality_score", "noise_score", "official", "filter_profile",
            F.col("category").alias("source_category"),
        )
    )
    none = {"form": "string", "items": "array<string>", "title": "string", "cik": "string"}
    posts = posts.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in posts.columns})
    df = normalize(posts).join(known, "source_id", "left").withColumns(
        {
            "manual": F.coalesce(F.col("source_type") == "manual", F.lit(False)), "strict": F.coalesce(F.col("filter_profile") == "strict", F.lit(False)),
            "official": F.coalesce("official", F.lit(False)), "enabled": F.coalesce("enabled", F.lit(False)),
        }
    )
    df = extracted(df, lexicon)
    return prepare(df.withColumns({"text": F.col("clean_text"), "names": F.concat("symbols", "countries")}), *PREPARED)


def assessed(posts: DataFrame, lexicons: Sequence[Lexicon], *texts: str) -> DataFrame:
    """Posts as of ``prepared`` with what each lexicon tells of them (``told_0`` and on) and a number of their own (``row``); written.

    This is all that later steps read of a post, so texts and tokens go to no disk but
    for the columns named in ``texts``.
    """
    exposures = E.exposures(lexicons[0].securities)
    best = F.array_max(F.transform("symbols", lambda t: F.try_element_at(exposures, t)))
    heavy = F.array(*(F.lit(x) for x in sorted(E.heavyweights(lexicons[0].securities)))).cast("array<string>")
    df, text = searched(posts, lexicons)
    df = df.withColumns(
        {
            "exposure": best, "has_mover": F.arrays_overlap("symbols", heavy), "empty": F.length(F.trim("clean_text")) == 0,
            "sure": F.transform(F.filter("tickers", lambda t: t["confidence"] >= 0.8), lambda t: t["ticker"]),
        }
    )
    columns, told = df.columns, []
    for lexicon in lexicons:
        has_filer = F.coalesce(F.trim("cik") != "", F.lit(False))
        subject = C.has_subject(F.col("category"), _has("symbols"), has_filer, _has("organizations"), F.col("figures"))
        fields = (
            "category", F.col("verdict.subcategory").alias("subcategory"), F.col("verdict").isNotNull().alias("decided"), F.col("noise.reason").alias("noise"),
            F.col("facts.verdict").alias("facts"), "filing", "said", subject.alias("subject"), "fixed", "credit",
        )
        df = scored(classified(df, text, lexicon), lexicon).select(*columns, *told, F.struct(*fields).alias(f"told_{len(told)}"))
        told.append(f"told_{len(told)}")
    return written(df.select(F.monotonically_increasing_id().alias("row"), *KEPT, *told, *texts))


def process(posts: DataFrame, sources: DataFrame, lexicon: Lexicon, now: Column | None = None, min_score: float = 50, max_age_minutes: float = 15) -> DataFrame:
    """The whole way of posts (id, source_id, text, url, ts, published_at): status, reason, event, score, impact and channels.

    ``sources`` has a row a source: enabled, source_type, quality_score,
    noise_score, official, filter_profile, category.  Posts may have provided
    (symbols), and form, items, title and cik of a filing.  The first gate that a
    post fails gives its reason; posts of manual sources pass the gates for
    duplicates, noise, commentary and age.  A duplicate corroborates the event of
    what it repeats.  The age of a post is taken at its ``ts``, or at ``now``.

    What needs one post only is computed for each; duplicates and clusters, which
    need those before, are two ordered passes (see ``dedupe`` and ``cluster``).
    """
    rows = assessed(prepared(posts, sources, lexicon), [lexicon], "clean_text")
    # Texts meet what has become of their posts at the very end, and once.
    df = judged(rows, 0, now, min_score, max_age_minutes).join(rows.select("row", "clean_text"), "row")
    impact = assess_impact(F.col("clean_text"), F.col("category"), F.col("subcategory"), F.col("_band"), F.size("tickers"), F.col("has_mover"), F.col("countries"), F.col("commodities"))
    published = F.col("rejection_reason").isNull()
    df = df.withColumn("impact", F.when(published, impact))
    channels = S.route(F.col("impact.market_moving"), F.col("impact.macro"), F.col("impact.relevance"), F.col("category"), F.size("tickers"))
    return df.select(
        "id", "source_id", "ts", "published_at", "headline", X.headline_and_body(F.col("clean_text"), normalized=True)["body"].alias("body"), "fingerprint", "matched_id", "similarity",
        "category", "subcategory", "tickers", "countries", "score", "band", "rejection_reason", "status", "event_id", "is_new", "supersedes", "novelty", "source_count",
        F.col("impact.relevance").alias("relevance"), F.col("impact.market_moving").alias("market_moving"), F.when(published, channels).alias("channels"),
    )


def judged(rows: DataFrame, lexicon: int = 0, now: Column | None = None, min_score: float = 50, max_age_minutes: float = 15) -> DataFrame:
    """Posts as of ``assessed``, on the rest of their way by one of the lexicons: as ``process``, without what needs their texts."""
    df = rows.select("row", *KEPT, f"told_{lexicon}.*")
    empty, readable = F.col("empty"), F.col("enabled") & ~F.col("empty") & F.col("decided")
    twins = find_duplicates(df.select("hashed.*", readable.alias("_readable")).drop("readable").withColumnRenamed("_readable", "readable"))
    df = df.drop("hashed").join(written(twins.select("id", "matched_id", F.col("reason").alias("twin_reason"), F.col("similarity").alias("twin_similarity"))), "id", "left")
    manual = F.col("manual")
    reason = S.first_rejection(
        (~F.col("enabled"), "SOURCE_DISABLED"),
        (empty, "EMPTY_TEXT"),
        ((F.col("twin_reason") == "DUPLICATE_URL") & ~manual, "DUPLICATE_URL"),
        (F.col("twin_reason").isNotNull() & ~manual, "DUPLICATE_TEXT"),
        (~F.col("decided"), "NO_CATEGORY"),
        (F.col("noise").isNotNull() & ~manual, "NOISE"),
        (F.col("strict") & ~manual & (F.col("facts") == "COMMENTARY"), "NOISE_COMMENTARY"),
        (F.col("filing").isNotNull() & ~F.col("filing").isin("CRITICAL", "HIGH"), "FILING_IMMATERIAL"),
        (~F.col("subject"), "NO_IDENTIFIED_SUBJECT"),
    )
    age = too_old(F.col("published_at"), now if now is not None else F.col("ts"), max_age_minutes)
    df = df.withColumns({"gate": F.when(reason == "NOISE", F.col("noise")).otherwise(reason), "stale": F.coalesce(age & ~manual, F.lit(False))})
    repeats = F.when(F.col("gate").startswith("DUPLICATE"), F.col("matched_id").cast("string"))
    rows = df.where(F.col("gate").isNull() | repeats.isNotNull()).select(
        "id", F.col("said").alias("headline"), "category", F.concat("sure", "countries", "organizations", "people", "commodities").alias("entities"),
        F.concat("symbols", "countries", "organizations", "people").alias("kept"), F.lit(0.0).alias("importance"), "source_id", "ts", "fixed", "credit", "manual", "stale", F.lit(float(min_score)).alias("least"), repeats.alias("repeats"),
    )
    events = cluster_posts(rows).withColumnRenamed("id", "_id")
    df = df.join(events, F.col("id").cast("string") == F.col("_id"), "left").withColumnRenamed("importance", "score")
    late = F.when(F.col("gate").isNull() & (F.col("score") < min_score), "BELOW_THRESHOLD").when(F.col("gate").isNull() & F.col("stale"), "NOISE_OLD_NEWS")
    df = df.withColumn("rejection_reason", F.coalesce("gate", late)).withColumn("band", S.band(F.col("score")))
    return df.select(
        "row", "id", "source_id", "ts", "published_at", F.col("said").alias("headline"), "fingerprint", "matched_id", F.col("twin_similarity").alias("similarity"),
        "category", "subcategory", F.col("symbols").alias("tickers"), "countries", "commodities", "has_mover", "score", F.when(F.col("score").isNotNull(), F.col("band")).alias("band"), F.col("band").alias("_band"),
        "rejection_reason", S.status_of(F.col("rejection_reason")).alias("status"), "event_id", "is_new", "supersedes", "novelty", "source_count",
    )
