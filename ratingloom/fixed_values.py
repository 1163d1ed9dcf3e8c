"""Values that have to equal the published ones for results to match.

Nothing here is logic: word lists, lookup tables, limits, patterns and texts,
each in its natural order.
"""

# The 22-notch ordinal rating scale, best to worst.
RATING_SCALE = [
    ("AAA", 21), ("AA+", 20), ("AA", 19), ("AA-", 18),
    ("A+", 17), ("A", 16), ("A-", 15),
    ("BBB+", 14), ("BBB", 13), ("BBB-", 12),
    ("BB+", 11), ("BB", 10), ("BB-", 9),
    ("B+", 8), ("B", 7), ("B-", 6),
    ("CCC+", 5), ("CCC", 4), ("CCC-", 3),
    ("CC", 2), ("C", 1), ("D", 0),
]

# Rating letters of each category; every other letter, and none, is BB.
CATEGORY_LETTERS = {
    "AA": ["AAA", "AA+", "AA", "AA-"],
    "A": ["A+", "A", "A-"],
    "BBB": ["BBB+", "BBB", "BBB-"],
}
DEFAULT_CATEGORY = "BB"
CATEGORIES = ["A", "AA", "BB", "BBB"]  # alphabetical, the label-index order

# The lowest notch of "A-" and of investment grade.
NOTCH_A_MINUS = 15
NOTCH_INVESTMENT_GRADE = 12

# Moody's letters on the common scale.
MOODYS_TO_COMMON = {
    "Aaa": "AAA",
    "Aa1": "AA+", "Aa2": "AA", "Aa3": "AA-",
    "A1": "A+", "A2": "A", "A3": "A-",
    "Baa1": "BBB+", "Baa2": "BBB", "Baa3": "BBB-",
    "Ba1": "BB+", "Ba2": "BB", "Ba3": "BB-",
}
# Fixed value: marks of a national-scale rating, e.g. "AAA (sau)", "KsaAAA".
NATIONAL_SCALE_PATTERN = r"(?i)\(sau\)|^\s*ksa"

PREFERRED_AGENCY = "tassnief"
AGENCY_COLUMNS = ["moodys", "fitch", "sp", "tassnief", "financial_analytics"]

# Feature blocks and their order.
RATIOS = ["liquid", "cumprof", "profitab", "leverage"]
AUDIT_FLAGS = ["AUSIZE", "AUOP", "EMP", "GCUP", "GCKAM", "REVKAM", "ASSETKAM", "LIABKAM", "OTHERKAM"]
FIRM_CONTROLS = ["FIRMAGE", "FIRMSIZE", "INDUSTRY"]
FLAGS = AUDIT_FLAGS + FIRM_CONTROLS
KAM_FIVE = ["GCKAM", "REVKAM", "ASSETKAM", "LIABKAM", "OTHERKAM"]
NEWS_FEATURES = ["sentiment_mean", "sentiment_std", "sentiment_pos_pct", "sentiment_neg_pct", "news_count"]
SENTIMENTS = NEWS_FEATURES[:4]
ALL_FEATURES = RATIOS + FLAGS + NEWS_FEATURES

FEATURE_BLOCKS = {
    "financials_only": RATIOS,
    "financials_plus_full_kams": RATIOS + FLAGS,
    "financials_plus_news": RATIOS + NEWS_FEATURES,
    "full_kams_plus_news": FLAGS + NEWS_FEATURES,
    "all_features": ALL_FEATURES,
}
THREE_MODELS = {
    "financials_only": RATIOS,
    "kams_only": FLAGS,
    "combined": RATIOS + FLAGS,
}

# One description per feature.
FEATURE_LABELS = {
    "liquid": "Liquidity (working capital / total assets)",
    "cumprof": "Cumulative profitability (retained earnings / total assets)",
    "profitab": "Profitability (EBIT / total assets)",
    "leverage": "Leverage (book equity / total liabilities)",
    "AUSIZE": "Auditor size (Big 4 = 1)",
    "AUOP": "Audit opinion (modified = 1)",
    "EMP": "Employee count (firm size proxy)",
    "GCUP": "Going-concern uncertainty paragraph (0/1)",
    "GCKAM": "KAM: going concern (0/1)",
    "REVKAM": "KAM: revenue recognition (0/1)",
    "ASSETKAM": "KAM: impairment / assets (0/1)",
    "LIABKAM": "KAM: liabilities (0/1)",
    "OTHERKAM": "KAM: other topics (0/1)",
    "FIRMAGE": "Firm age (years since incorporation)",
    "FIRMSIZE": "Firm size (log total assets)",
    "INDUSTRY": "Industry classification code",
    "sentiment_mean": "FinBERT mean article score (P(pos)−P(neg))",
    "sentiment_std": "FinBERT sentiment dispersion",
    "sentiment_pos_pct": "Share of articles with positive FinBERT score",
    "sentiment_neg_pct": "Share of articles with negative FinBERT score",
    "news_count": "Number of news articles in fiscal year",
}

# What marks an issuer as a financial-sector entity.
FINANCIAL_TICKERS = ["9596.SR", "8050.SR", "8060.SR", "8200.SR"]
FINANCIAL_SECTORS = ["financial services"]
FINANCIAL_INDUSTRY_PARTS = [
    "insurance", "reinsurance", "bank", "banks", "capital market", "asset management",
    "credit services", "mortgage", "consumer finance", "financial -", "shell companies",
]
FINANCIAL_NAME_PARTS = [
    "insurance", "reinsurance", "finance company", " islamic bank",
    "national bank", "commercial bank", "investment bank", " bank",
]

# Names under which a statement line appears, most preferred first.
LINE_ITEM_ALIASES = {
    "total_assets": ["Total Assets", "TotalAssets"],
    "current_assets": ["Current Assets", "CurrentAssets", "Total Current Assets"],
    "current_liabilities": ["Current Liabilities", "CurrentLiabilities", "Total Current Liabilities"],
    "retained_earnings": ["Retained Earnings", "RetainedEarnings"],
    "total_equity": [
        "Total Stockholder Equity", "Total Equity Gross Minority Interest", "Stockholders Equity",
        "Total Equity", "TotalEquityGrossMinorityInterest",
    ],
    "total_liabilities": [
        "Total Liabilities Net Minority Interest", "Total Liab", "Total Liabilities",
        "TotalLiabilitiesNetMinorityInterest",
    ],
    "ebit": ["EBIT", "Operating Income", "OperatingIncome"],
}

# Columns the financial tables drop, keep, and refresh.
UNUSED_FINANCIAL_COLUMNS = ["outlook", "rating_action", "data_available"]
FINANCIAL_CONTRACT = [
    "ticker", "company_name", "rating_date", "rating", "fiscal_year", "liquid", "cumprof", "profitab",
    "leverage", "total_assets", "total_liabilities", "total_equity", "yfinance_sector",
    "yfinance_industry", "statement_period_end",
]
ALIGNED_FINANCIALS = [
    "ticker", "company_name", "rating_agency", "rating", "fiscal_year",
    "liquid", "cumprof", "profitab", "leverage", "binary_target",
]
REFRESHED_COLUMNS = [
    "liquid", "cumprof", "profitab", "leverage", "total_assets", "total_liabilities", "total_equity",
    "yfinance_sector", "yfinance_industry", "statement_period_end",
]
RETIRED_YEARS = [2019, 2020]
YEAR_COLUMNS = ["fiscal_year", "fiscal_year_applicable"]

# Renamed issuers (new ticker -> the ticker of older news) and extra search phrases.
NEWS_TICKER_ALIASES = {"7204.SR": "2070.SR"}
EXTRA_SEARCH_PHRASES = {
    "2222.SR": ["Aramco", "Saudi Aramco", "Saudi Arabian Oil"],
    "3008.SR": ["Al Kathiri Holding", "Kathiri Holding", "AKHC"],
    "4321.SR": ["Cenomi Centers", "Cenomi", "Arabian Centres"],
    "5110.SR": ["Saudi Electricity Company", "Saudi Electricity", "Saudi Energy"],
}
SEARCH_PHRASE_LENGTH = 120
ARTICLE_FIELD_LENGTH = 4000
NEWS_FILE_PATTERN = r"(?i)^(.+)_([^_]+)_(\d{4})_news\.json$"
SCORING_BATCH = 16

# Decimals in a text, and the words two of the text checks look for.
NUMBER_PATTERN = r"(-?\d+\.\d{2,})"
RISK_WORDS = ["risk", "concern", "vulnerability", "weakness"]
STRENGTH_WORDS = ["strong", "solid", "adequate", "positive", "healthy"]

INVESTMENT_CATEGORIES = ["AA", "A", "BBB"]
RISK_CLASS_INVESTMENT = "Investment-grade (AA / A / BBB buckets)"
RISK_CLASS_SPECULATIVE = "Speculative (BB bucket)"

# Verdict ladders. Per ratio, the steps from high to low: a value above
# the limit takes the step; the last step (no limit) takes the rest.
# Side is "strength", "weakness" or none; {v} is the ratio with four decimals.
VERDICT_LADDERS = {
    "liquid": [
        (0.15, "strength", "Strong liquidity position (LIQUID={v}), indicating adequate working capital relative to total assets"),
        (0.05, "strength", "Adequate liquidity (LIQUID={v}), suggesting the company can meet short-term obligations"),
        (-0.05, "weakness", "Low liquidity (LIQUID={v}), indicating limited working capital buffer relative to total assets"),
        (None, "weakness", "Negative liquidity (LIQUID={v}), signaling potential difficulty meeting short-term obligations"),
    ],
    "cumprof": [
        (0.20, "strength", "Substantial accumulated profitability (CUMPROF={v}), reflecting a strong track record of retained earnings"),
        (0.05, "strength", "Positive cumulative profitability (CUMPROF={v}), showing consistent earnings retention"),
        (0.0, "weakness", "Modest cumulative profitability (CUMPROF={v}), suggesting limited earnings retention over time"),
        (None, "weakness", "Negative cumulative profitability (CUMPROF={v}), indicating accumulated losses exceed retained earnings"),
    ],
    "profitab": [
        (0.08, "strength", "Strong operational profitability (PROFITAB={v}), demonstrating efficient asset utilization for earnings"),
        (0.03, None, None),
        (0.0, "weakness", "Low operational profitability (PROFITAB={v}), suggesting limited earnings generation from assets"),
        (None, "weakness", "Negative profitability (PROFITAB={v}), indicating the company is not generating operating income from its assets"),
    ],
    "leverage": [
        (1.5, "strength", "Conservative financial structure (LEVERAGE={v}), with equity substantially exceeding liabilities"),
        (0.8, None, None),
        (0.3, "weakness", "Elevated debt reliance (LEVERAGE={v}), with liabilities forming a significant portion of financing"),
        (None, "weakness", "High leverage risk (LEVERAGE={v}), indicating heavy dependence on debt financing"),
    ],
}
NO_STRENGTH_TEXT = "No strong positive financial indicators identified from the ratios"
NO_WEAKNESS_TEXT = "No major financial weaknesses identified from the ratios"
# A ratio below its limit names the risk.
RISK_RULES = [
    ("liquid", 0.0, "Negative working capital may constrain operational flexibility and increase refinancing risk"),
    ("leverage", 0.5, "High leverage creates vulnerability to interest rate increases and credit tightening in the Saudi market"),
    ("profitab", 0.02, "Low profitability may limit the company's ability to service debt and fund growth without additional borrowing"),
]
NO_RISK_TEXT = (
    "Monitor macroeconomic conditions in Saudi Arabia and sector-specific regulatory changes "
    "that could affect creditworthiness"
)
NO_NEWS_TEXT = (
    "No news articles in cache for this year — sentiment features are neutral "
    "and may understate headline risk"
)
NEGATIVE_NEWS_LIMIT = -0.2
NEGATIVE_NEWS_TEXT = "Negative FinBERT news tone (sentiment_mean={v} across {n} articles)"
REVENUE_FLAG_TEXT = "Revenue-recognition KAM flagged — review accounting judgments and disclosures"
ASSET_FLAG_TEXT = "Asset / impairment KAM present — auditor focused on balance-sheet carrying values"
ANALYSIS_LIMIT = 0.05
ANALYSIS_ALIGNED = (
    "Ratios align with an investment-grade-style bucket ({p}): LIQUID={liquid}, CUMPROF={cumprof}, "
    "PROFITAB={profitab}, LEVERAGE={leverage}. KAM/news context should be read alongside these figures."
)
ANALYSIS_MODEST = (
    "The model predicts {p} but average ratio strength is modest (avg={avg}), so outcomes are "
    "sensitive to KAM and news signals."
)
ANALYSIS_WEAK = (
    "Weak liquidity (LIQUID={liquid}), profitability (PROFITAB={profitab}), and cumulative earnings "
    "(CUMPROF={cumprof}) support a {p} / speculative-bucket view."
)
ANALYSIS_MIXED = (
    "Mixed signals: model predicts {p} with avg ratio score {avg}; review KAM flags and FinBERT "
    "aggregates for confirmation."
)
ANALYSIS_NOTE = " Note: actual agency rating is {actual} (category {category}) vs predicted category {p}."
PROFILE_LIMITS = [(0.08, "solid"), (0.03, "moderate"), (None, "weak")]
OVERALL_TEXT = (
    "{name} ({ticker}) shows a {profile} financial profile for FY{year}, with the ML model "
    "predicting a {p} ({risk}) rating at {confidence} confidence."
)

VERDICT_FIELDS = [
    "company", "ticker", "fiscal_year", "predicted_rating", "risk_classification",
    "overall_assessment", "strengths", "weaknesses", "key_risks", "prediction_analysis",
]
VERDICT_SCHEMA = (
    "company string, ticker string, fiscal_year int, predicted_rating string, "
    "risk_classification string, overall_assessment string, strengths array<string>, "
    "weaknesses array<string>, key_risks array<string>, prediction_analysis string"
)

# Prompt texts.
PROMPT_RATIO_LABELS = {
    "liquid": "Liquidity (Working Capital / Total Assets)",
    "cumprof": "Cumulative Profitability (Retained Earnings / Total Assets)",
    "profitab": "Profitability (EBIT / Total Assets)",
    "leverage": "Leverage (Book Equity / Total Liabilities)",
}
PROMPT_FLAG_LABELS = {
    "GCKAM": "Auditor Key Audit Matter: going concern (1=present)",
    "REVKAM": "KAM: revenue recognition (1=present)",
    "ASSETKAM": "KAM: impairment / assets (1=present)",
    "LIABKAM": "KAM: liabilities (1=present)",
    "OTHERKAM": "KAM: other audit topics (1=present)",
}
PROMPT_NEWS_LABELS = {
    "sentiment_mean": "FinBERT mean article score (≈ P(pos)−P(neg))",
    "sentiment_std": "Dispersion of FinBERT scores across articles",
    "sentiment_pos_pct": "Share of articles scored positive by FinBERT",
    "sentiment_neg_pct": "Share of articles scored negative by FinBERT",
    "news_count": "Number of news articles in the fiscal year",
}
PROMPT_NO_RATIOS = "  No financial ratios available."
PROMPT_NO_NEWS = "  (No sentiment aggregates in row)"
PROMPT_HEAD = "You are a credit analyst writing a structured credit verdict for a Saudi-listed company."
PROMPT_TASK = (
    "TASK:\n"
    "Write a credit verdict in the following JSON format. Cite specific numbers from ratios, KAM flags,\n"
    "and sentiment fields where relevant. Do NOT invent information."
)
PROMPT_REPLY_HINTS = [
    ("overall_assessment", '"1-2 sentence summary using ratios + KAMs + news context"'),
    ("strengths", '["2-3 items citing provided numbers"]'),
    ("weaknesses", '["1-3 items citing provided numbers"]'),
    ("key_risks", '["1-2 forward-looking risks"]'),
    ("prediction_analysis", '"Does the evidence support the predicted category? Mention KAMs/news if material."'),
]
PROMPT_TAIL = "Return ONLY the JSON object, no other text."
MODEL_SYSTEM_PROMPT = (
    "You are a credit analyst specializing in Saudi Exchange (Tadawul) listed companies. "
    "Given financial ratios, auditor Key Audit Matter (KAM) dummies, FinBERT news aggregates, "
    "and a multicategory ML prediction (AA/A/BBB/BB), produce a structured JSON credit verdict. "
    "Cite specific numbers from the prompt only; do not invent facts."
)
SFT_INSTRUCTION = (
    "You are a credit analyst specializing in Saudi Exchange (Tadawul) listed companies. "
    "Given a company's financial ratios and ML model prediction, generate a structured "
    "credit verdict as a JSON object. Every claim must cite specific ratio values. "
    "Do not invent information beyond what is provided."
)

# Settings of the boosted model and of the benchmark models.
BOOSTING = {"rounds": 100, "depth": 3, "learning_rate": 0.1, "seed": 42}
FOREST = {"trees": 200, "depth": 8, "min_leaf": 2}
SINGLE_TREE = {"depth": 5, "min_leaf": 2}
NEIGHBOURS = 5
HIDDEN_LAYERS = [64, 32]
ITERATIONS = {"logistic": 2500, "svc": 8000, "perceptron": 800}
EARLY_STOPPING = {"share": 0.15, "patience": 20, "tolerance": 1e-4}
MAX_FOLDS = 5
CONFIDENCE_BINS = 12
SHOWN_SAMPLES = 8
REPORTED_FACTORS = 25
TOP_FEATURES = 3
DEPENDENCE_PAIRS = [("leverage", "profitab"), ("liquid", "cumprof"), ("news_count", "sentiment_mean")]

# Words counted per article for the three specified event features; the
# specification names the topics only, the words are this project's choice.
EVENT_WORDS = {
    "event_lawsuit": ["lawsuit", "litigation", "court", "sued"],
    "event_expansion": ["expansion", "expand", "growth", "acquisition"],
    "event_regulatory": ["regulatory", "regulator", "fine", "penalty"],
}
# A small word list for the default article scorer, this project's choice.
POSITIVE_WORDS = ["gain", "gains", "growth", "improve", "improved", "profit", "record", "rise", "strong", "upgrade"]
NEGATIVE_WORDS = ["decline", "default", "downgrade", "fall", "fine", "lawsuit", "loss", "losses", "risk", "weak"]
