"""Text columns: article text, search phrases, number formats, word counts, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import blank_to_null, text_or_empty


def article_text(title: Column, description: Column, snippet: Column) -> Column:
    """Title and description (or snippet), never empty: a single blank stands for no text.

    The description is replaced by the snippet only when it is missing or
    empty, not when it is blank.
    """
    body = blank_to_null(F.coalesce(F.when(description != "", description), snippet))
    return F.coalesce(blank_to_null(F.concat_ws(" ", blank_to_null(title), body)), F.lit(" "))


def search_phrase(company_name: Column, length: int | None = None) -> Column:
    """Name without bracketed parts, blanks squeezed; cut to `length` where a provider's query string is bounded."""
    plain = F.trim(F.regexp_replace(company_name, r"\([^)]*\)", ""))
    squeezed = F.regexp_replace(plain, r"\s+", " ")
    kept = F.when(squeezed != "", squeezed).otherwise(company_name)
    return F.substring(kept, 1, length) if length else kept


def ticker_to_stem(ticker: Column) -> Column:
    return F.replace(ticker, F.lit("."), F.lit("_"))


def stem_to_ticker(stem: Column) -> Column:
    """"4263_SR" to "4263.SR": only the last underscore is the dot."""
    return F.regexp_replace(stem, r"_([^_]*)$", r".$1")


def news_file_key(file_name: Column) -> tuple[Column, Column]:
    """(ticker, year) of "<number>_<suffix>_<year>_news.json", NULLs for other names."""
    matches = file_name.rlike(V.NEWS_FILE_PATTERN)
    part = lambda i: F.regexp_extract(file_name, V.NEWS_FILE_PATTERN, i)
    ticker = F.when(matches, F.concat_ws(".", part(1), part(2)))
    return ticker, F.when(matches, part(3).try_cast("int"))


def normalise_article(item: Column, ticker: Column, fallback: Column, length: int | None = None) -> Column:
    """Provider item (title, description, snippet, published_at, source, url, entities) as an article row.

    The search term is the first entity symbol that is not blank. With `length`
    the description and snippet are cut to so many characters, as published.
    """
    symbols = F.filter(
        F.transform(item["entities"], lambda e: F.trim(e["symbol"])), lambda s: s.isNotNull() & (s != "")
    )
    field = lambda c: F.substring(text_or_empty(c), 1, length) if length else text_or_empty(c)
    return F.struct(
        ticker.alias("ticker"),
        text_or_empty(item["title"]).alias("title"),
        field(item["description"]).alias("description"),
        field(item["snippet"]).alias("snippet"),
        item["published_at"].alias("published_at"),
        text_or_empty(item["source"]).alias("source_name"),
        text_or_empty(item["url"]).alias("url"),
        F.coalesce(F.get(symbols, F.lit(0)), fallback).alias("search_term"),
        F.lit(0.0).alias("sentiment_compound"),
        F.lit(0.0).alias("sentiment_pos"),
        F.lit(0.0).alias("sentiment_neg"),
        F.lit(1.0).alias("sentiment_neu"),
    )


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded from the exact binary value.

    The JVM rounds the shortest decimal that reads back as the number, so
    0.2345 would become 0.235 although the number is a little below it. Where
    the scaled number looks like a half, the part lost in scaling (exact, as
    the number is split into two short halves) decides; a true half goes to the
    even digit.
    """
    x, scale, pattern = c.cast("double"), float(10**digits), f"%.{digits}f"
    size = F.abs(x)
    whole = F.floor(size * scale)
    split = size * 134217729.0  # 2**27 + 1
    high = split - (split - size)
    rest = (high * scale - (whole + 0.5)) + (size - high) * scale
    nearest = F.when(rest < 0, whole).when(rest > 0, whole + 1).otherwise(whole + whole % 2)
    sign = F.when(x < 0, "-").otherwise("")
    half = F.concat(sign, F.format_string(pattern, nearest.cast("double") / scale))
    near_half = F.abs(size * scale - whole - 0.5) <= size * scale * 1e-15
    return F.when(near_half, half).otherwise(F.format_string(pattern, x))


def percent(c: Column, digits: int = 0) -> Column:
    """Share as a percentage; halves go to the even digit."""
    return F.concat(fixed(c.cast("double") * 100, digits), F.lit("%"))


def numbers_in(text: Column) -> Column:
    """All decimals with two or more places, as text."""
    return F.regexp_extract_all(text, F.lit(V.NUMBER_PATTERN), F.lit(1))


def fill(template: str, **values: Column) -> Column:
    """A text with {name} places filled by columns; NULL when one of them is NULL."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def joined_words(text: Column) -> Column:
    """The same words in one text, with a blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def blank_separated(text: Column) -> Column:
    """Lower-case tokens between blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def count_words(tokens: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(list(vocabulary))))


def lexicon_score(
    text: Column,
    positive: Sequence[str] = tuple(V.POSITIVE_WORDS),
    negative: Sequence[str] = tuple(V.NEGATIVE_WORDS),
) -> Column:
    """(positive - negative) / (positive + negative) word hits, 0 without hits.

    A stand-in for the model scorer with the same range and sign: it stays in
    generated code and needs no shuffle.
    """
    # one pass over the words of the text, counting both lists
    sums = F.aggregate(
        words(text), F.struct(F.lit(0).alias("up"), F.lit(0).alias("down")),
        lambda a, w: F.struct((a["up"] + w.isin(list(positive)).cast("int")).alias("up"), (a["down"] + w.isin(list(negative)).cast("int")).alias("down")),
        lambda a: F.try_divide((a["up"] - a["down"]).cast("double"), (a["up"] + a["down"]).cast("double")),
    )
    return F.coalesce(sums, F.lit(0.0))


def event_counts(text: Column) -> dict[str, Column]:
    """How often each event topic's words occur in a text."""
    tokens = words(text)
    return {name: count_words(tokens, vocabulary) for name, vocabulary in V.EVENT_WORDS.items()}


_ASCII_JSON = {"writeNonAsciiCharacterAsCodePoint": "true"}


def json_string(c: Column) -> Column:
    """A JSON string literal, non-ASCII characters escaped."""
    wrapped = F.to_json(F.array(F.coalesce(c, F.lit(""))), _ASCII_JSON)
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def json_value(c: Column, kind: str, indent: str) -> Column:
    """A value of an indented JSON object: "string", "number" or "strings"."""
    if kind == "number":
        return c.cast("string")
    if kind == "string":
        return json_string(c)
    inner = F.array_join(F.transform(c, json_string), f",\n{indent}  ")
    return F.when(F.size(c) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit(f"[\n{indent}  "), inner, F.lit(f"\n{indent}]"))
    )


def json_object(fields: Sequence[tuple[str, Column, str]]) -> Column:
    """An object with two-blank indentation and the fields in the given order."""
    lines = [F.concat(F.lit(f'  "{name}": '), json_value(c, kind, "  ")) for name, c, kind in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
