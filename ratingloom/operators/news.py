"""News: gaps, alias copies, article matching, scoring and per-key aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions.cleaning import to_number
from ratingloom.functions.text import event_counts, joined_words, search_phrase
from ratingloom.session import cut_lineage
from ratingloom.operators.panel import KEYS
from ratingloom.operators.picking import pick_first


# --- aggregates -----------------------------------------------------------------------------


def aggregate_scores(scored: DataFrame, score: str = "score", keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Mean, population deviation, share above and below 0, and count of article scores.

    A key whose articles are all missing (NULL score) counts no articles and
    gets zeros. Partial aggregation makes a key with most of the articles cheap.
    """
    s = F.col(score)
    zero = F.lit(0.0)
    return scored.groupBy(*keys).agg(
        F.coalesce(F.avg(s), zero).alias("sentiment_mean"),
        F.coalesce(F.stddev_pop(s), zero).alias("sentiment_std"),
        F.coalesce(F.avg(F.when(s.isNotNull(), (s > 0).cast("double"))), zero).alias("sentiment_pos_pct"),
        F.coalesce(F.avg(F.when(s.isNotNull(), (s < 0).cast("double"))), zero).alias("sentiment_neg_pct"),
        F.count(s).alias("news_count"),
    )


def update_news(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Base rows with a news file take the new aggregates, the others keep theirs."""
    new = fresh.select(*KEYS, F.lit(True).alias("_found"), *[F.col(c).alias(f"_new_{c}") for c in V.NEWS_FEATURES])
    joined = base.join(new, KEYS, "left")
    taken = {c: F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in V.NEWS_FEATURES}
    return joined.withColumns(taken).drop("_found", *[f"_new_{c}" for c in V.NEWS_FEATURES])


def finalise_news(df: DataFrame) -> DataFrame:
    """Count 0 where there is none, sentiments left NULL, coverage stated."""
    count = F.coalesce(to_number(F.col("news_count")), F.lit(0.0)).cast("long") if "news_count" in df.columns else F.lit(0)
    sentiments = {
        c: to_number(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in V.SENTIMENTS
    }
    out = df.withColumns({**sentiments, "news_count": count})
    out = out.withColumn("has_news_coverage", (F.col("news_count") > 0).cast("int"))
    return out.select(*KEYS, *V.NEWS_FEATURES, "has_news_coverage")


def news_on_panel(panel: DataFrame, news: DataFrame) -> DataFrame:
    """One finalised news row per panel key; `news` has at most one row per key."""
    return finalise_news(panel.select(*KEYS).join(news, KEYS, "left"))


def event_features(articles: DataFrame, text: str = "text") -> DataFrame:
    """Sums of topic word counts per key."""
    counted = articles.select(*KEYS, *[c.alias(n) for n, c in event_counts(F.col(text)).items()])
    return counted.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in V.EVENT_WORDS])


# --- scoring --------------------------------------------------------------------------------

Scorer = Callable[[list[str]], Sequence[float]]


def score_articles(
    df: DataFrame, text: Column, load_scorer: Callable[[], Scorer], batch: int = V.SCORING_BATCH, name: str = "score"
) -> DataFrame:
    """P(positive) - P(negative) per row from a model loaded once per Python worker.

    `load_scorer` runs on the executor and returns a function from a list of
    at most `batch` texts to their scores.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = load_scorer()
        for texts in batches:
            out: list[float] = []
            for start in range(0, len(texts), batch):  # only these texts become Python's
                out.extend(float(x) for x in scorer(texts.slice(start, batch).to_pylist()))
            yield pa.array(out, pa.float64())

    return df.withColumn(name, scored(text))


# --- gaps -----------------------------------------------------------------------------------


def news_gap(panel: DataFrame, files: DataFrame, refetch_empty: bool = False) -> DataFrame:
    """Panel keys without a news file; with `refetch_empty` an empty file counts as none.

    `files` has the keys and `article_count` of every file.
    """
    have = files.where(F.col("article_count") > 0) if refetch_empty else files
    return panel.select(*KEYS, "company_name").distinct().join(have.select(*KEYS), KEYS, "left_anti")


def parse_pairs(df: DataFrame, column: str = "pair") -> DataFrame:
    """TICKER:YEAR texts as keys, split at the last colon."""
    c = F.col(column)
    return df.select(
        F.trim(F.regexp_replace(c, r":[^:]*$", "")).alias("ticker"),
        F.trim(F.regexp_extract(c, r":([^:]*)$", 1)).try_cast("int").alias("fiscal_year"),
    )


def keep_allowed(gap: DataFrame, allowed: DataFrame) -> DataFrame:
    return gap.join(allowed.select(*KEYS), KEYS, "left_semi")


def allowed_outside_gap(gap: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allow-list entries that need no fetch."""
    return allowed.select(*KEYS).distinct().join(gap.select(*KEYS), KEYS, "left_anti")


def copy_alias_news(gap: DataFrame, aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """News documents of the old ticker, rewritten for the new ticker of gap keys.

    `aliases` has (ticker, source_ticker); `documents` has the keys and an
    `articles` array.
    """
    wanted = gap.select(*KEYS).join(aliases, "ticker").withColumnRenamed("ticker", "_new")
    source = documents.withColumnRenamed("ticker", "source_ticker")
    copied = source.join(wanted, ["source_ticker", "fiscal_year"])
    renamed = F.transform("articles", lambda a: a.withField("ticker", F.col("_new")))
    return copied.select(F.col("_new").alias("ticker"), "fiscal_year", renamed.alias("articles"), "source_ticker")


def gap_after_aliases(gap: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Gap keys that no alias file fills."""
    filled = files.select(F.col("ticker").alias("source_ticker"), "fiscal_year").distinct().join(aliases, "source_ticker")
    return gap.join(filled.select(*KEYS), KEYS, "left_anti")


# --- matching -------------------------------------------------------------------------------

# Tiers in the order they are tried. The two narrower symbol tiers select a part
# of the first one's articles, so over a table they can never be the first to
# find any: a symbol match is tier 0.
TIER_SYMBOL, TIER_PHRASE, TIER_EXTRA = 0, 3, 4


def entity_phrases(entities: DataFrame, extra: Mapping[str, Sequence[str]] = V.EXTRA_SEARCH_PHRASES) -> DataFrame:
    """(ticker, tier, phrase): the company phrase, then extra phrases in their order."""
    own = entities.select("ticker", F.lit(TIER_PHRASE).alias("tier"), search_phrase(F.col("company_name")).alias("phrase"))
    rows = [(t, TIER_EXTRA + i, p) for t, phrases in extra.items() for i, p in enumerate(phrases)]
    if not rows:
        return own
    more = entities.sparkSession.createDataFrame(rows, "ticker string, tier int, phrase string")
    return own.unionByName(more.join(entities.select("ticker"), "ticker", "left_semi"))


#: Characters of the phrases of one automaton at most; more phrases are looked for by several, one after the other.
AUTOMATON_CHARS = 1 << 20


def phrase_hits(articles: DataFrame, phrases: DataFrame, text: str = "text", article_id: str = "article_id") -> DataFrame:
    """(article, ticker, tier) where the article's words contain the phrase's words in a row.

    The phrases form an automaton (a trie with failure links), which reads every text
    once and reports whole phrases only, so no word or word pair becomes a row and the cost does not
    grow with the number or the length of the phrases. Phrases and texts are compared as their words
    with a blank on each side. A phrase without a word matches nothing; a NULL text holds none.
    """
    wanted = phrases.select("ticker", "tier", joined_words(F.col("phrase")).alias("_phrase")).where("_phrase <> ''").distinct()
    numbered = cut_lineage(wanted.select("_phrase").distinct().withColumn("_number", F.monotonically_increasing_id()), "phrases")
    parts = -(-(numbered.agg(F.sum(F.length("_phrase") + 2)).first()[0] or 1) // AUTOMATON_CHARS)
    texts = articles.select(article_id, joined_words(F.col(text)).alias("_text"))
    schema = f"`{article_id}` {texts.schema[article_id].dataType.simpleString()}, _number bigint"
    found = None
    for part in range(parts):
        own = numbered.where(F.pmod(F.xxhash64("_phrase"), F.lit(parts)) == part).toArrow()
        shared = articles.sparkSession.sparkContext.broadcast(list(zip(own["_phrase"].to_pylist(), own["_number"].to_pylist(), strict=True)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for phrase, number in shared.value:
                automaton.add_word(f" {phrase} ", number)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                hits = [list({n for _, n in automaton.iter(f" {t} ")}) if t else [] for t in batch.column(1).to_pylist()]
                rows = pa.array([k for k, own in enumerate(hits) for _ in own], pa.int64())
                numbers = pa.array([n for own in hits for n in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), numbers], names=[article_id, "_number"])

        hits = texts.mapInArrow(look, schema)
        found = hits if found is None else found.unionByName(hits)
    named = wanted.join(numbered, "_phrase").select("ticker", "tier", "_number")
    return found.join(named, "_number").select(article_id, "ticker", "tier").distinct()


def match_articles(entities: DataFrame, articles: DataFrame, symbols: DataFrame, phrases: DataFrame) -> DataFrame:
    """Articles of each (ticker, year) from the first tier that finds any.

    `articles`: article_id, fiscal_year, text. `symbols`: article_id, symbol.
    Tiers are the ticker symbol, the company phrase, then each extra phrase.
    """
    tagged = symbols.join(entities.select("ticker"), symbols["symbol"] == entities["ticker"])
    by_symbol = tagged.select("article_id", "ticker", F.lit(TIER_SYMBOL).alias("tier"))
    hits = by_symbol.unionByName(phrase_hits(articles, phrases)).distinct()
    # both the best tier and its articles come from these rows; the texts are not read again
    dated = cut_lineage(hits.join(articles.select("article_id", "fiscal_year"), "article_id"), "hits")
    best = dated.groupBy(*KEYS).agg(F.min("tier").alias("tier"))
    return dated.join(best, [*KEYS, "tier"])


def dedupe_urls(articles: DataFrame, order: Sequence[Column], url: str = "url", keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """The first article of each url and key; articles without a url are all kept."""
    trimmed = articles.withColumn(url, F.coalesce(F.trim(F.col(url)), F.lit("")))
    named = pick_first(trimmed.where(F.col(url) != ""), [*keys, url], order)
    return named.unionByName(trimmed.where(F.col(url) == "").select(*named.columns))
