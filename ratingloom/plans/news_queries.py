"""Queries on news and article text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ratingloom import fixed_values as V
from ratingloom.functions import text as TX
from ratingloom.operators import article_model as AM
from ratingloom.operators import news as N
from ratingloom.operators.panel import KEYS
from ratingloom.plans import roles as R
from ratingloom.plans.common import i8, longs, news_sql, r6, rounded, rounded_news
from ratingloom.plans.registry import query
from ratingloom.plans.roles import with_roles
from ratingloom.session import scratch_path
from ratingloom.sources import news_files as NF


@query("news_agg", with_roles(["news"], f"SELECT ticker, fiscal_year, {news_sql()}, news_count FROM news"))
def news_agg(spark, sf):
    return rounded_news(N.aggregate_scores(R.articles(spark, sf)))


# Old aggregates come from views only, new ones from purchases and clicks.
@query(
    "news_update",
    with_roles(
        ["articles"],
        f"""WITH agg AS (SELECT ticker, fiscal_year, event_type IN ('purchase', 'click') AS fresh, avg(score) AS sentiment_mean, stddev_pop(score) AS sentiment_std,
  avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS sentiment_pos_pct, avg(CASE WHEN score < 0 THEN 1.0 ELSE 0.0 END) AS sentiment_neg_pct,
  count(*) AS news_count FROM articles WHERE event_type IN ('view', 'purchase', 'click') GROUP BY 1, 2, 3),
m AS (SELECT o.ticker, o.fiscal_year, {", ".join(f"CASE WHEN n.ticker IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in V.NEWS_FEATURES)}
  FROM agg o LEFT JOIN agg n ON n.fresh AND o.ticker = n.ticker AND o.fiscal_year = n.fiscal_year WHERE NOT o.fresh)
SELECT ticker, fiscal_year, {news_sql()}, news_count FROM m""",
    ),
)
def news_update(spark, sf):
    rows = R.articles(spark, sf)
    old = N.aggregate_scores(rows.where("event_type = 'view'"))
    new = N.aggregate_scores(rows.where("event_type IN ('purchase', 'click')"))
    return rounded_news(N.update_news(old, new))


@query(
    "news_on_panel",
    with_roles(
        ["panel_names", "news"],
        f"""SELECT p.ticker, p.fiscal_year, {news_sql("n.")}, {i8("coalesce(n.news_count, 0)", "news_count")},
  {i8("CASE WHEN n.news_count > 0 THEN 1 ELSE 0 END", "has_news_coverage")}
FROM panel_names p LEFT JOIN news n ON n.ticker = p.ticker AND n.fiscal_year = p.fiscal_year""",
    ),
)
def news_on_panel(spark, sf):
    out = N.news_on_panel(R.panel_names(spark, sf), N.aggregate_scores(R.articles(spark, sf)))
    return longs(rounded_news(out), ["news_count", "has_news_coverage"])


def _files(spark, sf):
    """File index: a key's file is empty when all its events are errors."""
    return R.articles(spark, sf).groupBy(*KEYS).agg(F.count_if(F.col("event_type") != "error").alias("article_count"))


_FILES = "files AS (SELECT ticker, fiscal_year, count(*) FILTER (event_type <> 'error') AS article_count FROM articles GROUP BY 1, 2)"


@query(
    "news_gap",
    with_roles(
        ["panel_names", "articles"],
        f"""WITH {_FILES} SELECT p.ticker, p.fiscal_year, p.company_name FROM panel_names p
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.ticker = p.ticker AND f.fiscal_year = p.fiscal_year AND f.article_count > 0)""",
    ),
)
def news_gap(spark, sf):
    return N.news_gap(R.panel_names(spark, sf), _files(spark, sf), refetch_empty=True)


def _allowed(spark, sf):
    """Allow-list texts TICKER:YEAR from the large orders."""
    rows = R.rating_rows(spark, sf).where("amount > 400000")
    return N.parse_pairs(rows.select(F.concat("ticker", F.lit(":"), F.col("fiscal_year").cast("string")).alias("pair")))


@query(
    "news_gap_allowed",
    with_roles(
        ["panel_names", "articles", "rating_rows"],
        """SELECT p.ticker, p.fiscal_year, p.company_name FROM panel_names p
WHERE NOT EXISTS (SELECT 1 FROM articles f WHERE f.ticker = p.ticker AND f.fiscal_year = p.fiscal_year)
  AND EXISTS (SELECT 1 FROM rating_rows r WHERE r.amount > 400000 AND r.ticker = p.ticker AND r.fiscal_year = p.fiscal_year)""",
    ),
)
def news_gap_allowed(spark, sf):
    gap = N.news_gap(R.panel_names(spark, sf), _files(spark, sf))
    return N.keep_allowed(gap, _allowed(spark, sf))


@query(
    "allowed_outside_gap",
    with_roles(
        ["articles", "rating_rows"],
        """SELECT DISTINCT r.ticker, r.fiscal_year FROM rating_rows r WHERE r.amount > 400000
  AND EXISTS (SELECT 1 FROM articles f WHERE f.ticker = r.ticker AND f.fiscal_year = r.fiscal_year)""",
    ),
)
def allowed_outside_gap(spark, sf):
    gap = N.news_gap(R.panel_names(spark, sf), _files(spark, sf))
    return N.allowed_outside_gap(gap, _allowed(spark, sf))


def _aliases(spark, sf):
    """Renamed issuers: the customer 150 numbers on carries the older news of this one."""
    users = R.table(spark, sf, "events").select("user_id").distinct()
    n = users.agg(F.max("user_id") + 1).scalar()
    return users.select(R.ticker_of(F.col("user_id") + n).alias("ticker"), R.ticker_of(F.col("user_id")).alias("source_ticker"))


def _documents(spark, sf):
    """One single-article document per event, so that no key's articles are ever gathered in one row."""
    article = F.struct(F.col("ticker").alias("ticker"), F.col("event_type").alias("title"), F.col("event_id").alias("event_id"))
    return R.articles(spark, sf).select(*KEYS, F.array(article).alias("articles"))


@query(
    "alias_news",
    with_roles(
        ["panel_names", "articles"],
        """SELECT p.ticker, p.fiscal_year, a.ticker AS source_ticker, a.event_id, p.ticker AS article_ticker
FROM panel_names p JOIN articles a ON a.fiscal_year = p.fiscal_year
  AND CAST(replace(a.ticker, '.SR', '') AS BIGINT) + (SELECT max(user_id) + 1 FROM events) = CAST(replace(p.ticker, '.SR', '') AS BIGINT)
WHERE NOT EXISTS (SELECT 1 FROM articles f WHERE f.ticker = p.ticker AND f.fiscal_year = p.fiscal_year)""",
    ),
)
def alias_news(spark, sf):
    gap = N.news_gap(R.panel_names(spark, sf), _files(spark, sf))
    copied = N.copy_alias_news(gap, _aliases(spark, sf), _documents(spark, sf))
    rows = copied.select(*KEYS, "source_ticker", F.explode("articles").alias("a"))
    return rows.select(*KEYS, "source_ticker", F.col("a.event_id").alias("event_id"), F.col("a.ticker").alias("article_ticker"))


@query(
    "gap_after_aliases",
    with_roles(
        ["panel_names", "articles"],
        """SELECT p.ticker, p.fiscal_year, p.company_name FROM panel_names p
WHERE NOT EXISTS (SELECT 1 FROM articles f WHERE f.ticker = p.ticker AND f.fiscal_year = p.fiscal_year)
  AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.fiscal_year = p.fiscal_year
    AND CAST(replace(a.ticker, '.SR', '') AS BIGINT) + (SELECT max(user_id) + 1 FROM events) = CAST(replace(p.ticker, '.SR', '') AS BIGINT))""",
    ),
)
def gap_after_aliases(spark, sf):
    files = _files(spark, sf)
    gap = N.news_gap(R.panel_names(spark, sf), files)
    return N.gap_after_aliases(gap, _aliases(spark, sf), files)


# --- files ----------------------------------------------------------------------------------


def _file_texts(spark, sf):
    """News files as (name, text): bad names for sign-ups, cut JSON for errors, empty lists for views."""
    e = R.articles(spark, sf)
    kind = F.col("event_type")
    number = F.regexp_replace("ticker", r"\.SR$", "")
    good = F.concat(number, F.lit("_SR_"), F.col("fiscal_year").cast("string"), F.lit("_NEWS.json"))
    article = F.struct(F.col("ticker").alias("ticker"), F.concat(F.lit(" "), kind).alias("title"), F.col("props").alias("description"), F.concat(F.lit("u"), F.col("score").cast("string")).alias("url"))
    articles = F.when(kind != "view", F.array(article)).otherwise(F.array().cast("array<struct<ticker:string,title:string,description:string,url:string>>"))
    body = F.to_json(F.struct(F.col("ticker"), F.col("fiscal_year").alias("year"), articles.alias("articles")))
    return e.select(
        F.when(kind == "signup", F.concat(number, F.lit("_news.json"))).otherwise(good).alias("file_name"),
        F.when(kind == "error", body.substr(F.lit(1), F.length(body) - 5)).otherwise(body).alias("value"),
    )


@query(
    "news_files",
    with_roles(
        ["articles"],
        """SELECT ticker, fiscal_year, CASE WHEN event_type <> 'view' THEN event_type || ' ' || trim(props) END AS text FROM articles
WHERE event_type NOT IN ('signup', 'error')""",
    ),
)
def news_files(spark, sf):
    return NF.article_rows(NF.parse_news(_file_texts(spark, sf))).select(*KEYS, "text")


@query(
    "news_rejects",
    with_roles(
        ["articles"],
        """SELECT CASE WHEN event_type = 'signup' THEN 'file name' ELSE 'json' END AS reject_reason, count(*) AS files FROM articles
WHERE event_type IN ('signup', 'error') GROUP BY 1""",
    ),
)
def news_rejects(spark, sf):
    return NF.rejected(NF.parse_news(_file_texts(spark, sf))).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("files"))


@query(
    "news_file_index",
    with_roles(
        ["articles"],
        """SELECT ticker, fiscal_year, count(*) AS files, CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS article_count
FROM articles WHERE event_type NOT IN ('signup', 'error') GROUP BY 1, 2""",
    ),
)
def news_file_index(spark, sf):
    index = NF.file_index(NF.parse_news(_file_texts(spark, sf)))
    return index.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files"), F.sum("article_count").alias("article_count"))


def _folder(spark, sf) -> str:
    """A folder with a news file per ticker and year that holds all its articles; those of 1997 are cut off, sign-ups give a name without a year."""
    e = R.articles(spark, sf)
    number = F.regexp_replace("ticker", r"\.SR$", "")
    article = F.struct("ticker", F.col("event_type").alias("title"), F.col("score").cast("string").alias("description"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"))
    # bounded: the articles of one ticker and year are one document by the format
    documents = e.groupBy("ticker", "fiscal_year").agg(F.collect_list(F.when(F.col("event_type") != "view", article)).alias("articles"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    body = F.to_json(F.struct("ticker", F.col("fiscal_year").alias("year"), "articles"))
    year = F.concat(F.lit("_"), F.col("fiscal_year").cast("string"))
    good = F.struct(F.concat(number, F.lit("_SR"), year, F.lit("_news.json")).alias("file_name"), F.when(F.col("fiscal_year") == 1997, body.substr(F.lit(1), F.length(body) - 5)).otherwise(body).alias("value"))
    bad = F.struct(F.concat(number, F.lit("SR"), F.translate(year, "_", ""), F.lit("_news.json")).alias("file_name"), body.alias("value"))
    path = scratch_path(spark, "news-folder")
    files = F.when(F.col("signups") > 2, F.array(good, bad)).otherwise(F.array(good))
    NF.write_news_folder(documents.select(F.inline(files)), path)
    return path


@query(
    "news_folder",
    with_roles(
        ["articles"],
        f"""WITH wanted AS (SELECT * FROM articles WHERE fiscal_year IN (1996, 1999) AND event_type <> 'view')
SELECT k.ticker, k.fiscal_year, {r6("coalesce(avg(score), 0)", "sentiment_mean", 9)}, CAST(count(w.event_id) AS BIGINT) AS news_count
FROM (SELECT DISTINCT ticker, fiscal_year FROM articles WHERE fiscal_year IN (1996, 1999)) k LEFT JOIN wanted w ON w.ticker = k.ticker AND w.fiscal_year = k.fiscal_year GROUP BY 1, 2""",
    ),
)
def news_folder(spark, sf):
    """Aggregates of two years from a folder of news files, of which the other years' are never opened."""
    files = NF.read_news_folder(spark, _folder(spark, sf), years=[1996, 1999])
    accepted = NF.accepted(NF.parse_news(files)).select(*KEYS, F.explode_outer("articles").alias("a"))
    scored = accepted.select(*KEYS, F.col("a.description").try_cast("double").alias("score"))
    out = N.aggregate_scores(scored)
    return rounded(out.select(*KEYS, "sentiment_mean", "news_count"), ["sentiment_mean"], 9)


@query(
    "news_folder_files",
    with_roles(
        ["articles"],
        """WITH k AS (SELECT ticker, fiscal_year, count(*) FILTER (WHERE event_type = 'signup') > 2 AS twice FROM articles GROUP BY 1, 2)
SELECT CASE WHEN fiscal_year IN (1996, 1997) THEN 'read' ELSE 'skipped' END AS state, count(*) AS files, count(*) FILTER (WHERE fiscal_year = 1997) AS cut_off FROM k GROUP BY 1
UNION ALL SELECT 'without a key', count(*), 0 FROM k WHERE twice HAVING count(*) > 0""",
    ),
)
def news_folder_files(spark, sf):
    """How many files of a folder a read of two years opens, skips, and rejects for their content or name."""
    path = _folder(spark, sf)
    index = NF.folder_index(spark, path)
    parsed = NF.parse_news(NF.read_news_folder(spark, path, years=[1996, 1997]))
    opened = index.join(parsed.select("file_name", "reject_reason"), "file_name", "left").withColumn("opened", F.col("fiscal_year").isin(1996, 1997))
    state = F.when(F.col("fiscal_year").isNull(), "without a key").when(F.col("opened"), "read").otherwise("skipped")
    return opened.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("reject_reason") == "json").alias("cut_off"))


# --- text -----------------------------------------------------------------------------------

_URL = "CASE WHEN event_type = 'error' THEN '' ELSE event_type || '/' || CAST(score > 0 AS INTEGER) END"


@query(
    "url_dedupe",
    with_roles(
        ["articles"],
        f"""SELECT ticker, fiscal_year, url, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year, url ORDER BY event_id) AS rn
  FROM (SELECT *, {_URL} AS url FROM articles)) WHERE rn = 1 OR url = ''""",
    ),
)
def url_dedupe(spark, sf):
    url = F.when(F.col("event_type") == "error", " ").otherwise(F.concat("event_type", F.lit("/"), (F.col("score") > 0).cast("int").cast("string")))
    rows = R.articles(spark, sf).select(*KEYS, "event_id", url.alias("url"))
    return N.dedupe_urls(rows, [F.col("event_id")])


@query(
    "article_text",
    """SELECT conv_id, turn, CASE WHEN d <> '' AND t <> '' THEN t || ' ' || d WHEN t <> '' THEN t WHEN d <> '' THEN d ELSE ' ' END AS text FROM
(SELECT conv_id, turn, trim(CASE WHEN role = 'system' THEN '' ELSE role END) AS t,
  trim(CASE WHEN role = 'user' THEN text WHEN role = 'assistant' THEN text ELSE '  ' END, E' \\t\\n\\r\\f\\x0b') AS d FROM conversations)""",
)
def article_text(spark, sf):
    rows = R.table(spark, sf, "conversations")
    role = F.col("role")
    title = F.when(role == "system", "").otherwise(F.concat(F.lit("  "), role))
    description = F.when(role == "user", F.col("text")).when(role == "system", "  ")
    snippet = F.when(role == "assistant", F.col("text"))
    return rows.select("conv_id", "turn", TX.article_text(title, description, snippet).alias("text"))


@query(
    "search_phrase",
    """SELECT page_id, CASE WHEN s <> '' THEN s ELSE n END AS phrase, substr(CASE WHEN s <> '' THEN s ELSE n END, 1, 120) AS search_term FROM (SELECT page_id, n,
  regexp_replace(trim(regexp_replace(n, '\\([^)]*\\)', '', 'g')), '[ \\t\\n\\f\\r]+', ' ', 'g') AS s FROM (SELECT page_id,
  CASE WHEN page_id % 5 = 0 THEN '(' || url || ')' ELSE '  ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '   (' || url || ')  Co.' END AS n FROM pages))""",
)
def search_phrase(spark, sf):
    pages = R.table(spark, sf, "pages")
    bracketed = F.concat(F.lit("("), F.col("url"), F.lit(")"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    name = F.when(F.col("page_id") % 5 == 0, bracketed).otherwise(F.concat(F.lit("  "), title, F.lit("   "), bracketed, F.lit("  Co.")))
    return pages.select("page_id", TX.search_phrase(name).alias("phrase"), TX.search_phrase(name, V.SEARCH_PHRASE_LENGTH).alias("search_term"))


@query(
    "ticker_stems",
    with_roles(
        ["panel_names"],
        """SELECT ticker, fiscal_year, replace(ticker, '.', '_') AS stem, ticker AS back, replace(ticker, '.', '_') || '_' || fiscal_year || '_news.json' AS file_name,
  ticker AS file_ticker, fiscal_year AS file_year FROM panel_names""",
    ),
)
def ticker_stems(spark, sf):
    stem = TX.ticker_to_stem(F.col("ticker"))
    rows = R.panel_names(spark, sf).select(*KEYS, stem.alias("stem"), F.concat(stem, F.lit("_"), F.col("fiscal_year").cast("string"), F.lit("_news.json")).alias("file_name"))
    ticker, year = TX.news_file_key(F.col("file_name"))
    return rows.select("*", TX.stem_to_ticker(F.col("stem")).alias("back"), ticker.alias("file_ticker"), year.alias("file_year"))


@query(
    "normalised_articles",
    """SELECT doc_id, trim(source) AS title, trim(text, E' \\t\\n\\r\\f\\x0b') AS description, substr(trim(text, E' \\t\\n\\r\\f\\x0b'), 1, 4000) AS cut_description, '' AS snippet, lang AS source_name, '' AS url,
  CASE WHEN lang = 'en' THEN source ELSE 'fallback ' || source END AS search_term, CAST(1.0 AS DOUBLE) AS sentiment_neu FROM documents""",
)
def normalised_articles(spark, sf):
    docs = R.table(spark, sf, "documents")
    symbol = F.when(F.col("lang") == "en", F.col("source"))
    item = F.struct(
        F.concat(F.lit(" "), F.col("source")).alias("title"), F.col("text").alias("description"), F.lit(None).cast("string").alias("snippet"),
        F.lit(None).cast("string").alias("published_at"), F.col("lang").alias("source"), F.lit(" ").alias("url"),
        F.array(F.struct(F.lit(" ").alias("symbol")), F.struct(symbol.alias("symbol"))).alias("entities"),
    )
    fallback = F.concat(F.lit("fallback "), F.col("source"))
    made, cut = TX.normalise_article(item, F.col("source"), fallback), TX.normalise_article(item, F.col("source"), fallback, V.ARTICLE_FIELD_LENGTH)
    both = docs.select("doc_id", made.alias("a"), cut["description"].alias("cut_description"))
    return both.select("doc_id", "a.title", "a.description", "cut_description", "a.snippet", "a.source_name", "a.url", "a.search_term", "a.sentiment_neu")


_WORDS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"
# word lists whose words occur in the invented prose
_UP, _DOWN = ["the", "and", "la", "die", "el"], ["of", "in", "le", "der", "que"]


def _hits(words) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({_WORDS}, lambda w: w IN ({inside})))"


@query(
    "lexicon_score",
    f"""SELECT doc_id, {r6(f"coalesce(({_hits(_UP)} - {_hits(_DOWN)}) / nullif({_hits(_UP)} + {_hits(_DOWN)}, 0)::DOUBLE, 0)", "score")} FROM documents""",
)
def lexicon_score(spark, sf):
    return rounded(R.table(spark, sf, "documents").select("doc_id", TX.lexicon_score(F.col("text"), _UP, _DOWN).alias("score")), ["score"])


def _load_word_scorer():
    """Scores texts by two word lists; stands for a model that is loaded once per worker."""
    up, down = set(_UP), set(_DOWN)

    def score(texts):
        out = []
        for t in texts:
            tokens = "".join(ch if ch.isalnum() else " " for ch in t.lower()).split()
            p, n = sum(w in up for w in tokens), sum(w in down for w in tokens)
            out.append((p - n) / (p + n) if p + n else 0.0)
        return np.array(out)

    return score


@query(
    "batch_scored_news",
    f"""WITH s AS (SELECT source, lang, coalesce(({_hits(_UP)} - {_hits(_DOWN)}) / nullif({_hits(_UP)} + {_hits(_DOWN)}, 0)::DOUBLE, 0) AS score FROM documents)
SELECT source, lang, {r6("avg(score)", "sentiment_mean")}, {r6("stddev_pop(score)", "sentiment_std")}, {r6("avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END)", "sentiment_pos_pct")},
  {r6("avg(CASE WHEN score < 0 THEN 1.0 ELSE 0.0 END)", "sentiment_neg_pct")}, count(*) AS news_count FROM s GROUP BY 1, 2""",
)
def batch_scored_news(spark, sf):
    docs = R.table(spark, sf, "documents").select("source", "lang", "text")
    scored = N.score_articles(docs, F.col("text"), _load_word_scorer)
    return rounded(N.aggregate_scores(scored, keys=["source", "lang"]), V.SENTIMENTS)


def learned_scores(spark, sf):
    """doc_id, source, lang, quality, held_out, score of every document, by a model of the labelled ones that are not held out.

    Good quality stands for a positive mood: like it, and unlike toxicity, it is a property of the whole text.
    """
    docs = R.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    labels = R.table(spark, sf, "labels").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.join(labels, "doc_id", "left").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    learned = rows.where(~F.col("held_out")).withColumn("mood", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative"))
    path = scratch_path(spark, "article-model")
    AM.save(AM.fit(learned, "text", "mood"), spark, path)
    return N.score_articles(rows, F.col("text"), AM.scorer(AM.load(spark, path), spark, "positive", "negative")).drop("text")


@query("learned_news")
def learned_news(spark, sf):
    """The news aggregates per source and language from a learned scorer."""
    return N.aggregate_scores(learned_scores(spark, sf), keys=["source", "lang"])


def _count_sql(words) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(regexp_split_to_array(lower(text || ' ' || source || ' growth'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w IN ({inside})))"


@query(
    "event_features",
    "SELECT source AS ticker, length(lang) AS fiscal_year, " + ", ".join(i8(f"sum({_count_sql(w)})", n) for n, w in V.EVENT_WORDS.items()) + " FROM documents GROUP BY 1, 2",
)
def event_features(spark, sf):
    docs = R.table(spark, sf, "documents")
    text = F.concat("text", F.lit(" "), F.col("source"), F.lit(" growth"))
    rows = docs.select(F.col("source").alias("ticker"), F.length("lang").alias("fiscal_year"), text.alias("text"))
    return longs(N.event_features(rows), ["fiscal_year", *V.EVENT_WORDS])


# Entities are named after the whole benchmark items; a document's source number is
# its symbol. Entities beyond the last source are found by phrase only.
_NORMAL = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NAME = "coalesce(nullif(trim(regexp_replace(text, '\\([^)]*\\)', '', 'g')), ''), text)"


@query(
    "match_tier",
    f"""WITH ent AS (SELECT 'src' || item_id AS ticker, {_NORMAL.format(x=_NAME)} AS phrase FROM benchmark),
art AS (SELECT doc_id AS article_id, 1990 + doc_id % 7 AS fiscal_year, source, ' ' || {_NORMAL.format(x="text")} || ' ' AS words FROM documents),
hits AS (SELECT a.article_id, a.fiscal_year, e.ticker, 0 AS tier FROM art a JOIN ent e ON a.source = e.ticker
  UNION ALL SELECT a.article_id, a.fiscal_year, e.ticker, 3 FROM art a JOIN ent e ON e.phrase <> '' AND contains(a.words, ' ' || e.phrase || ' ')
  UNION ALL SELECT a.article_id, a.fiscal_year, 'src39', 4 FROM art a WHERE contains(a.words, ' the ')
  UNION ALL SELECT a.article_id, a.fiscal_year, 'src39', 5 FROM art a WHERE contains(a.words, ' of the and '))
SELECT article_id, {i8("fiscal_year", "fiscal_year")}, ticker, {i8("tier", "tier")} FROM (SELECT *, min(tier) OVER (PARTITION BY ticker, fiscal_year) AS best FROM hits) WHERE tier = best""",
)
def match_tier(spark, sf):
    items = R.table(spark, sf, "benchmark")
    entities = items.select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("ticker"), F.col("text").alias("company_name"))
    docs = R.table(spark, sf, "documents")
    articles = docs.select(F.col("doc_id").alias("article_id"), (1990 + F.col("doc_id") % 7).alias("fiscal_year"), "text")
    symbols = docs.select(F.col("doc_id").alias("article_id"), F.col("source").alias("symbol"))
    phrases = N.entity_phrases(entities, {"src39": ["the", "of the and"]})
    out = N.match_articles(entities, articles, symbols, phrases)
    return longs(out.select("article_id", "fiscal_year", "ticker", "tier"), ["fiscal_year", "tier"])
