"""How alerts look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import escape_markdown, let, normalize_whitespace, tokenize, truncate_words


def alert_headline(c: Column, limit: int = 60) -> Column:
    """Upper case, shortened at a word."""
    return F.upper(truncate_words(normalize_whitespace(c), limit))


def alert_body(headline: Column, body: Column, limit: int = 320) -> Column:
    """The body, shortened; empty if all its words are in the headline."""

    def shortened(text: Column) -> Column:
        told = lambda part: F.size(F.array_except(tokenize(part), tokenize(headline))) == 0
        # No token goes over a space: mostly the first words show that there is more, and the whole body is not cut into tokens.
        restates = told(F.substring_index(text, " ", 24)) & told(text)
        return F.when(restates | text.isNull(), "").otherwise(truncate_words(text, limit))

    return let(normalize_whitespace(body), shortened)


def render_alert(masthead: Column, headline: Column, when: Column, body: Column) -> Column:
    bold = lambda c: F.concat(F.lit("**"), escape_markdown(c), F.lit("**"))
    return F.concat_ws("\n\n", bold(masthead), bold(headline), when, F.when(body != "", escape_markdown(body)))


def leaks_metadata(c: Column) -> Column:
    """A handle, a link or a line of internal labels in what is to be published."""
    return c.rlike("(^|\\s)@[A-Za-z0-9_]{2,}") | c.rlike("(?i)https?://") | c.rlike("(?m)^(?:SOURCE|SCORE|CATEGORY|BAND|CONFIDENCE)\\s*:")


def chunks(c: Column, limit: int) -> Column:
    """The text in pieces of at most ``limit`` characters, cut at line breaks or spaces where there are any."""
    words = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{limit}}}(?=\\s|$)|.{{1,{limit}}}"), F.lit(0))
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
