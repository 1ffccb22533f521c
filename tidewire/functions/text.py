"""Text primitives as Spark columns; all run in the JVM and null texts give null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.terms import Matched

#: Words without weight in comparisons.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "into", "is",
    "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "will", "with", "would", "after",
    "over", "says", "say", "said", "new", "more", "than", "about", "up", "down", "out", "we", "you", "i",
)

#: Named entities that occur in feed titles, with what they stand for.
ENTITIES = (
    ("amp|#38", "&"), ("lt|#60", "<"), ("gt|#62", ">"), ("quot|#34", '"'), ("apos|#39", "'"), ("nbsp", " "),
    ("rsquo|lsquo", "'"), ("rdquo|ldquo", '"'), ("mdash|ndash", "-"),
)

#: Without ways back: none of them could match otherwise.
TOKEN = "\\d++(?:[.,]\\d++)*+|[a-z][a-z0-9]*+(?:-[a-z0-9]++)*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLANK = "\\s\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; the single spaces that most runs are stay as they are."""
    return F.trim(F.regexp_replace(c, f"[[^!-~]&&[{_BLANK}]](?:[{_BLANK}]+|(?<! ))", " "))


def where_marked(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """A change of the texts that hold a mark, without which it would change nothing."""
    return let(c, lambda x: F.when(F.contains(x, F.lit(mark)), change(x)).otherwise(x))


def urls_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?i)\\bhttps?://[^\\s<>\"')]+"), F.lit(0))


def strip_urls(c: Column) -> Column:
    return normalize_whitespace(where_marked(c, "://", lambda x: F.regexp_replace(x, "(?i)\\bhttps?://[^\\s<>\"')]+", " ")))


def strip_handles(c: Column) -> Column:
    """Without a leading retweet mark and without @handles."""
    bare = lambda x: F.regexp_replace(x, "(?i)^\\s*RT\\s+@[A-Za-z0-9_]{1,15}:\\s*", "")
    return normalize_whitespace(where_marked(c, "@", lambda x: F.regexp_replace(bare(x), "(^|\\s)@[A-Za-z0-9_]{1,15}\\b", "$1")))


def strip_trailing_hashtags(c: Column) -> Column:
    """Without three or more hashtags at the end."""
    return F.trim(where_marked(c, "#", lambda x: F.regexp_replace(x, "(?:\\s*#[A-Za-z0-9_]+){3,}\\s*$", "")))


def tokenized_from(c: Column) -> Column:
    """The text in which tokens stand: lower case, apostrophes straight, possessives folded."""
    low = F.translate(F.lower(c), "‘’", "''")
    return where_marked(low, "'s", lambda x: F.regexp_replace(x, "([a-z0-9])'s\\b", "$1"))


def tokenize(c: Column) -> Column:
    """Lower-case words and numbers: hyphenated words and decimals whole, possessives folded."""
    return F.regexp_extract_all(tokenized_from(c), F.lit(TOKEN), F.lit(0))


def significant(tokens: Column) -> Column:
    """Tokens of two characters or more that are no stop words."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def fingerprint(tokens: Column) -> Column:
    """Identity of a text's significant content, whatever its order: 32 hexadecimal digits."""
    words = F.sort_array(F.array_distinct(significant(tokens)))
    return F.substring(F.sha2(F.array_join(words, " "), 256), 1, 32)


def simhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit hashes."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets: 1 if both are empty, 0 if one is."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def wire_headline(c: Column) -> Column:
    """Upper case, without a leading BREAKING or its like, and without marks at the end."""
    c = normalize_whitespace(c)
    c = F.regexp_replace(c, "(?i)^\\s*(?:\\*+\\s*)?(?:BREAKING|JUST\\s+IN|UPDATE|URGENT|ALERT|NEWS|FLASH)\\s*[:\\-—]\\s*", "")
    c = F.regexp_replace(c, "^\\*+\\s*", "")
    return F.upper(F.regexp_replace(c, "[\\s.:;,\\-—–]+$", ""))


def truncate_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space if one is near enough the end, with three dots for what is cut."""
    text = F.trim(c)
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (space > limit * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "[\\s.,;:—–-]+$", ""), F.lit("...")))


def cleaned(c: Column) -> Column:
    """A post's own words: entities decoded; without links, handles and hashtags at the end; single spaces.

    White space is looked at once: after that only steps that change a text can leave more than one space in it.
    """
    bare = where_marked(strip_urls(decode_entities(c)), "@", strip_handles)
    return where_marked(bare, "#", lambda x: normalize_whitespace(strip_trailing_hashtags(x)))


def headline_and_body(c: Column, normalized: bool = False) -> Column:
    """struct(headline, body): cut at a dash, or after the first sentence; a long text without either is shortened."""
    return let(c if normalized else normalize_whitespace(c), _headline_and_body)


def _headline_and_body(text: Column) -> Column:
    dash = "^(.{15,120}?)\\s+[—–]\\s+(.+)$"
    sentence = "^(.*?[.!?])\\s+(?=[A-Z\"“'])(.*)$"

    def parts(head: Column, body: Column) -> Column:
        return F.struct(head.alias("headline"), body.alias("body"))

    return (
        F.when(text == "", parts(F.lit(""), F.lit("")))
        .when(text.rlike(dash), parts(wire_headline(F.regexp_extract(text, dash, 1)), F.regexp_extract(text, dash, 2)))
        .when(text.rlike(sentence), parts(wire_headline(F.regexp_extract(text, sentence, 1)), F.regexp_extract(text, sentence, 2)))
        .when(F.length(text) <= 140, parts(wire_headline(text), F.lit("")))
        .otherwise(parts(wire_headline(truncate_words(text, 120)), text))
    )


def is_all_caps(c: Column) -> Column:
    """Three letters or more, none of them lower-case."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) >= 3) & (letters == F.upper(letters))


def decode_entities(c: Column) -> Column:
    """Named entities, and numbered ones of characters up to U+00FF and common marks beyond."""
    return where_marked(c, "&", lambda x: F.when(x.rlike("&#?[A-Za-z0-9]+;"), _decoded(x)).otherwise(x))


def _decoded(c: Column) -> Column:
    for names, value in ENTITIES:
        c = F.regexp_replace(c, f"(?i)&(?:{names});", value.replace("\\", "\\\\").replace("$", "\\$"))
    numbers = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("&#(\\d{1,3});"), F.lit(1)))
    c = let(c, lambda x: F.aggregate(numbers(x), x, lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), F.char(n.cast("long")))))
    for code in (8211, 8212, 8216, 8217, 8220, 8221, 8230, 8364):
        c = F.regexp_replace(c, f"(?i)&#(?:{code}|x{code:x});", chr(code))
    return c


def strip_html(c: Column) -> Column:
    return normalize_whitespace(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")))


def term_pattern(terms: Sequence[str]) -> str:
    """One pattern for any of the terms, with no letter or digit beside it; longer terms first."""
    body = "|".join(re.escape(t.lower()) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return f"(?i)(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])"


def has_term(c: Column | Matched, *terms: str) -> Column:
    """Whether a text has one of the terms: by a pattern, or of a text that was searched for all terms at once by what was found."""
    if isinstance(c, Matched):
        return c.has(terms)
    return c.rlike(term_pattern(terms)) if terms else F.lit(False)


def count_terms(c: Column | Matched, terms: Sequence[str]) -> Column:
    """How many different terms a text has."""
    return c.count(terms) if isinstance(c, Matched) else sum((has_term(c, t).cast("int") for t in terms), F.lit(0))


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, "‘’", "''")


def headline_equivalent(c: Column) -> Column:
    """What headlines of one fact share: no wire prefix, no marks, US, UK and EU without dots."""
    c = F.upper(c)
    c = F.regexp_replace(c, "^\\s*(?:[A-Z][A-Z0-9.\\s]{1,24}?):\\s+", "")
    for pair in ("US", "UK", "EU"):
        c = F.regexp_replace(c, f"\\b{pair[0]}\\.?\\s?{pair[1]}\\.?\\b", pair)
    c = F.replace(c, F.lit("&"), F.lit(" AND "))
    return normalize_whitespace(F.regexp_replace(c, "[.,;:'\"“”‘’()\\[\\]]", " "))


def figures_in(c: Column) -> Column:
    """The different numbers of a text, without separators of thousands."""
    raw = F.regexp_extract_all(c, F.lit("-?\\d[\\d,]*\\.?\\d*"), F.lit(0))
    numbers = F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))


def different_figures(a: Column, b: Column) -> Column:
    """Both texts have numbers, and none in common."""
    x, y = figures_in(a), figures_in(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


#: Words that turn a headline's meaning.
NEGATIONS = (
    "no not never without denies denied rejects rejected collapse collapses collapsed fails failed failure halts "
    "halted cancels cancelled canceled withdraws withdrawn refuses refused blocks blocked ends ended breaks"
).split()


def is_negated(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in NEGATIONS)))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\*_`~|>])", "\\\\$1")


def unescape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, "\\\\([\\\\*_`~|>])", "$1")


def strip_links(c: Column) -> Column:
    """Labels of markdown links stay, addresses go."""
    c = F.regexp_replace(c, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    return F.regexp_replace(c, "https?://\\S+|www\\.\\S+", "")


def strip_boilerplate(c: Column, phrases: Sequence[str] = ()) -> Column:
    """Without the given phrases, chat time tags, leading clock times, counts of reactions and marks at the ends."""
    if phrases:
        any_ = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
        c = F.regexp_replace(c, f"(?i)(?:{any_})", "")
    c = F.regexp_replace(c, "(?i)<t:\\d+(?::[a-z])?>\\s*[-—–:]?\\s*", "")
    c = F.regexp_replace(c, "(?i)\\b\\d{1,2}:\\d{2}\\s*(?:AM|PM)?\\s*[-—–:]\\s*", "")
    c = F.regexp_replace(c, "\\*\\*\\[[^\\]]*\\]\\(\\s*\\)[^\\n]*?\\*\\*\\s*_\\*\\s*\\*_\\s*$", "")
    return F.trim(F.regexp_replace(c, "^[\\s*:-]+|[\\s*:-]+$", ""))


def headlines_in(c: Column) -> Column:
    """The headlines of a post that lists several: one a line, and a new one at each clock time; five characters or fewer are none."""
    parts = F.flatten(F.transform(F.split(c, "(?=\\b\\d{1,2}:\\d{2}\\s*[AP]M\\b)"), lambda x: F.split(x, "\\n")))
    bare = F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[•\\-\\s]+", ""))
    return F.filter(bare, lambda x: F.length(x) > 5)


def names_contract(c: Column) -> Column:
    """An option contract, as in ``472C``."""
    return F.coalesce(c.rlike("(?i)\\b\\d+\\s*[PC]\\b"), F.lit(False))


def is_echo(text: Column, stripped: Column, quoted: Column) -> Column:
    """A post that adds nothing: a repost without a word of its own, or a quotation nearly equal to what it quotes."""
    bare = text.rlike("(?i)^\\s*RT\\s+@") & (stripped == "")
    same = jaccard(significant(tokenize(stripped)), significant(tokenize(quoted))) > 0.9
    return F.coalesce(bare, F.lit(False)) | F.coalesce((quoted != "") & same, F.lit(False))
