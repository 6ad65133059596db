"""Word lists, lookup maps and rule tables.

Everything in this module is data that results depend on literally, so it is kept
together, in plain text and in rule order. No logic lives here.
"""

from __future__ import annotations

from typing import NamedTuple


class Bucket(NamedTuple):
    """One topical blocking key: what text, categories and dates point to it."""

    name: str
    keywords: tuple[str, ...]
    categories: tuple[str, ...]
    priority: int
    window_start: str | None = None
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


# Topical buckets in evaluation order (the fold over them is order-dependent).
BUCKETS: tuple[Bucket, ...] = (
    Bucket("politics_trump_2024",
           ("trump", "donald", "maga", "republican nominee", "gop nominee", "trump 2024"),
           ("Politics", "Elections"), 1, "2024-01-01", ("trump",)),
    Bucket("politics_biden_2024",
           ("biden", "joe biden", "democratic nominee", "democrat nominee", "biden 2024"),
           ("Politics", "Elections"), 1, "2024-01-01", ("biden",)),
    Bucket("politics_election_2024",
           ("election", "presidential", "president", "2024 election", "electoral", "vote"),
           ("Politics", "Elections"), 2, "2024-01-01"),
    Bucket("politics_congress",
           ("congress", "senate", "house", "representative", "senator", "midterm"),
           ("Politics",), 2),
    Bucket("crypto_bitcoin_price",
           ("bitcoin", "btc", "bitcoin price", "$50000", "$100000"),
           ("Crypto", "Cryptocurrency"), 1),
    Bucket("crypto_ethereum",
           ("ethereum", "eth", "ether", "ethereum price"),
           ("Crypto", "Cryptocurrency"), 1),
    Bucket("crypto_general",
           ("crypto", "cryptocurrency", "coin", "token", "defi", "nft"),
           ("Crypto", "Cryptocurrency"), 3),
    Bucket("sports_nfl_2024",
           ("nfl", "super bowl", "football", "playoffs", "chiefs", "bills"),
           ("Sports", "NFL"), 1, "2024-09-01"),
    Bucket("sports_nba_2024",
           ("nba", "basketball", "finals", "championship", "lakers", "warriors"),
           ("Sports", "NBA"), 1, "2024-10-01"),
    Bucket("sports_soccer",
           ("world cup", "fifa", "soccer", "football", "uefa", "premier league"),
           ("Sports",), 2),
    Bucket("economics_fed_rates",
           ("fed", "federal reserve", "interest rate", "rate cut", "rate hike", "jerome powell"),
           ("Economics",), 1),
    Bucket("economics_inflation",
           ("inflation", "cpi", "consumer price", "deflation", "prices"),
           ("Economics",), 2),
    Bucket("economics_recession",
           ("recession", "gdp", "economic growth", "unemployment", "job"),
           ("Economics",), 2),
    Bucket("business_tech_stocks",
           ("apple", "microsoft", "google", "amazon", "meta", "tesla", "nvidia"),
           ("Business",), 1),
    Bucket("business_ipo",
           ("ipo", "public offering", "listing", "debut"),
           ("Business",), 2),
    Bucket("entertainment_awards",
           ("oscar", "academy award", "emmy", "golden globe", "grammy"),
           ("Entertainment",), 2),
    Bucket("entertainment_celebrity",
           ("celebrity", "movie", "actor", "actress", "director", "film"),
           ("Entertainment",), 3),
    Bucket("weather_hurricane",
           ("hurricane", "storm", "landfall", "category", "wind speed"),
           ("Weather",), 1),
    Bucket("weather_temperature",
           ("temperature", "heat", "cold", "record", "degrees"),
           ("Weather",), 2),
    Bucket("science_space",
           ("spacex", "nasa", "rocket", "mars", "moon", "satellite"),
           ("Science", "Technology"), 2),
    Bucket("tech_ai",
           ("ai", "artificial intelligence", "gpt", "chatgpt", "machine learning"),
           ("Technology",), 2),
)

# Title-keyword buckets, first match wins. Every inner tuple is a set of
# substrings that must all occur; the alternatives of a rule are OR-ed.
KEYWORD_BUCKETS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("politics_trump", (("trump",), ("donald",))),
    ("politics_biden", (("biden",), ("joe biden",))),
    ("politics_election_2024", (("election", "2024"),)),
    ("crypto_bitcoin", (("bitcoin",), ("btc",))),
    ("crypto_ethereum", (("ethereum",), ("eth",))),
    ("sports_nfl", (("nfl",), ("super bowl",))),
    ("sports_nba", (("nba",), ("basketball",))),
    ("economics_macro", (("recession",), ("gdp",))),
    ("economics_fed", (("fed",), ("interest rate",))),
    ("geopolitics_china", (("china",), ("xi jinping",))),
    ("geopolitics_russia", (("russia",), ("ukraine",))),
    ("tech_ai", (("ai",), ("artificial intelligence",))),
)
# Category fallback of the keyword buckets.
CATEGORY_BUCKETS = {
    "Politics": "politics_general",
    "Crypto": "crypto_general",
    "Sports": "sports_general",
    "Economics": "economics_general",
    "Technology": "tech_general",
}

# Stop words of the Jaccard measure and of the overlap count.
JACCARD_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
                      "with", "by", "will", "be", "is", "are")
OVERLAP_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
                      "with", "by")
# Words removed from the keyword title hash.
HASH_STOP_WORDS = ("will", "who", "when", "what", "how", "is", "are", "the", "a", "an", "in", "on",
                   "at", "by", "for", "before", "after")

# Historical success rate per bucket, and the rate for all others.
BUCKET_SUCCESS_RATES = {
    "politics_trump_2024": 0.85,
    "crypto_bitcoin_price": 0.75,
    "sports_nfl_2024": 0.70,
    "economics_fed_rates": 0.80,
}
DEFAULT_SUCCESS_RATE = 0.6
SIMILAR_PAIR_CONFIDENCE = 0.7

# Shared-keyword points of the additive pair score, best first.
SCORE_KEYWORDS = (("trump", 40), ("bitcoin", 40), ("recession", 40), ("election", 30), ("nfl", 30),
                  ("nba", 30), ("ethereum", 30), ("china", 20), ("fed", 20))
# The smaller keyword table of the pre-filter report.
PREFILTER_KEYWORDS = (("trump", 30), ("bitcoin", 30), ("recession", 30), ("nfl", 20),
                      ("election", 20))
# Keyword lists of the candidate and matching operators.
CANDIDATE_KEYWORDS = ("trump", "bitcoin", "election", "nfl")
TOPLIST_KEYWORDS = ("trump", "biden", "election", "bitcoin", "ethereum", "nfl", "nba",
                    "super bowl", "world cup", "recession", "fed")
BONUS_KEYWORDS = ("trump", "bitcoin", "election", "super bowl")
STRONG_PAIR_KEYWORDS = ("trump", "bitcoin", "ethereum", "super bowl", "world cup", "recession")
RELATED_PAIR_KEYWORDS = ("election", "president", "nfl", "nba", "crypto", "stock", "economy")

# Sentiment keywords.
POSITIVE_WORDS = ("will", "likely", "expected", "strong", "positive", "bullish", "growth",
                  "increase", "win", "success", "good", "high")
NEGATIVE_WORDS = ("unlikely", "decline", "fall", "negative", "bearish", "loss", "fail", "drop",
                  "weak", "low", "poor", "crisis")

# Listing category -> (category, confidence, title keywords), by venue.
VENUE_CATEGORY_RULES = {
    "kalshi": (
        ("Politics", "Politics", 1.0, ("election", "vote", "politician")),
        ("Economics", "Economics", 1.0, ("fed", "inflation", "gdp", "unemployment")),
        ("Sports", "Sports", 1.0, ("nfl", "nba", "mlb", "nhl", "soccer")),
        ("Finance", "Economics", 0.9, ("stock", "market", "trading")),
        ("Technology", "Technology", 1.0, ("tech", "ai", "crypto", "bitcoin")),
        ("Weather", "Weather", 1.0, ("hurricane", "temperature", "storm")),
        ("Entertainment", "Entertainment", 1.0, ("movie", "oscar", "celebrity")),
        ("Science", "Science", 1.0, ("space", "nasa", "research")),
    ),
    "polymarket": (
        ("Politics", "Politics", 1.0, ("election", "trump", "biden")),
        ("Crypto", "Technology", 0.9, ("bitcoin", "ethereum", "crypto")),
        ("Sports", "Sports", 1.0, ("super bowl", "world cup", "olympics")),
        ("Business", "Economics", 0.8, ("earnings", "ipo", "stock")),
        ("Pop Culture", "Entertainment", 0.9, ("celebrity", "awards", "music")),
        ("Science & Tech", "Technology", 1.0, ("ai", "space", "innovation")),
        ("Miscellaneous", "Other", 0.5, ()),
    ),
}

# Category standardization maps; anything else becomes the default.
KALSHI_CATEGORY_MAP = {
    "Economics": "Economics", "Politics": "Politics", "Elections": "Politics",
    "Weather": "Weather", "Sports": "Sports", "Entertainment": "Entertainment",
    "Technology": "Technology", "Science": "Science", "Business": "Business",
    "Crypto": "Cryptocurrency", "Cryptocurrency": "Cryptocurrency",
}
POLYMARKET_CATEGORY_MAP = {
    "Politics": "Politics", "Crypto": "Cryptocurrency", "Economics": "Economics",
    "Sports": "Sports", "Pop Culture": "Entertainment", "Business": "Business",
    "Science": "Science", "Technology": "Technology", "Gaming": "Entertainment",
    "Other": "Other",
}
UNIFIED_CATEGORY_MAP = {
    "politics": "politics", "elections": "politics", "world": "politics",
    "economics": "economics", "economic": "economics", "finance": "economics",
    "sports": "sports", "sport": "sports",
    "science and technology": "technology", "technology": "technology", "tech": "technology",
    "crypto": "crypto", "cryptocurrency": "crypto",
    "entertainment": "entertainment", "culture": "entertainment",
    "climate and weather": "climate", "climate": "climate",
    "other": "other",
}
DOCUMENTED_CATEGORY_MAP = {
    "Politics": "politics", "Sports": "sports", "Cryptocurrency": "crypto",
    "Technology": "technology", "Science": "technology", "Economics": "economics",
    "Business": "economics", "Climate": "climate", "Health": "health", "World": "world",
    "Culture": "culture", "Entertainment": "culture",
}

# First-match title categorization, by rule set.
TITLE_CATEGORY_RULES = {
    "kalshi": (
        ("Politics", ("election", "president", "congress", "senate", "vote", "poll")),
        ("Cryptocurrency", ("bitcoin", "crypto", "ethereum", "btc", "eth")),
        ("Economics", ("gdp", "inflation", "fed", "economy", "unemployment")),
        ("Sports", ("nfl", "nba", "mlb", "nhl", "super bowl", "world cup")),
        ("Weather", ("temperature", "weather", "hurricane", "rain")),
        ("Entertainment", ("movie", "oscar", "emmy", "celebrity")),
        ("Business", ("stock", "company", "ipo", "earnings")),
    ),
    "polymarket": (
        ("Politics", ("election", "president", "congress", "trump", "biden", "vote")),
        ("Cryptocurrency", ("bitcoin", "crypto", "ethereum", "btc", "eth", "coin")),
        ("Economics", ("fed", "inflation", "gdp", "economy", "market", "stock")),
        ("Sports", ("nfl", "nba", "mlb", "super bowl", "championship", "game")),
        ("Entertainment", ("movie", "celebrity", "award", "music", "tv")),
        ("Business", ("company", "ipo", "earnings", "revenue")),
    ),
    "populate": (
        ("politics", ("trump", "biden", "election", "president", "nomination", "ambassador",
                      "congress", "senate")),
        ("crypto", ("bitcoin", "crypto", "ethereum")),
        ("economics", ("economy", "gdp", "inflation", "recession", "fed", "interest")),
        ("climate", ("climate", "temperature", "weather")),
        ("sports", ("sports", "nfl", "nba", "championship", "world cup", "olympics")),
        ("technology", ("tech", "ai", "apple", "google", "tesla")),
    ),
    "capture": (
        ("politics", ("trump", "biden", "election", "president", "senate", "congress", "democrat",
                      "republican", "vote")),
        ("crypto", ("bitcoin", "btc", "ethereum", "eth", "crypto", "blockchain")),
        ("sports", ("nfl", "nba", "mlb", "sport", "game", "team", "championship", "soccer",
                    "football")),
        ("technology", ("ai", "tech", "apple", "google", "microsoft", "openai")),
        ("economics", ("economy", "market", "stock", "gdp", "inflation", "fed")),
    ),
}

# Event type by title words, then by category word.
EVENT_TYPE_TITLE_RULES = (
    ("political", ("election", "vote", "president", "senate", "congress")),
    ("economic", ("fed", "rate", "inflation", "gdp", "unemployment")),
    ("sports", ("super bowl", "championship", "playoffs", "world cup")),
    ("technology", ("bitcoin", "crypto", "ai", "tech", "ipo")),
    ("weather", ("hurricane", "storm", "temperature", "weather")),
)
EVENT_TYPE_CATEGORY_RULES = (
    ("political", "politics"),
    ("economic", "economics"),
    ("sports", "sports"),
    ("technology", "technology"),
    ("weather", "weather"),
)

# Repair rules for uncategorized listings, first match wins.
REPAIR_CATEGORY_REGEXES = (
    ("politics", "trump|biden|election|president|senate|congress|democrat|republican|nominee|"
                 "nomination|campaign"),
    ("crypto", "bitcoin|btc|ethereum|eth|crypto|blockchain|token|coin|defi"),
    ("sports", "nfl|nba|mlb|nhl|soccer|football|basketball|baseball|hockey|sport|championship|"
               "world cup|olympics"),
    ("technology", "ai|artificial intelligence|openai|chatgpt|tech|technology|apple|google|"
                   "microsoft|tesla|meta"),
    ("economics", "economy|economic|gdp|inflation|recession|fed|federal reserve|stock|market|dow|"
                  "nasdaq|s&p"),
    ("climate", "climate|temperature|weather|global warming|carbon|emission|environment"),
    ("health", "health|medicine|covid|pandemic|disease|vaccine|medical|hospital|drug"),
    ("culture", "movie|film|music|celebrity|entertainment|oscar|grammy|tv|show|series"),
)
# Words the wider LIKE-based variant adds to the rule of the same name.
REPAIR_CATEGORY_EXTRA_WORDS = {
    "politics": ("vote", "poll"),
    "sports": ("game", "match", "team"),
    "technology": ("amazon",),
}
# Sequential overrides by title word, the last match wins.
OVERRIDE_CATEGORY_WORDS = (
    ("football", "sports"), ("basketball", "sports"), ("nfl", "sports"), ("nba", "sports"),
    ("bitcoin", "crypto"), ("eth", "crypto"), ("trump", "politics"), ("election", "politics"),
    ("supreme court", "politics"), ("justice", "politics"),
)

# Platform seed rows.
PLATFORM_SEED = (
    ("polymarket", "Polymarket", "https://polymarket.com", "https://gamma-api.polymarket.com",
     True, 60, "active"),
    ("kalshi", "Kalshi", "https://kalshi.com", "https://trading-api.kalshi.com/trade-api/v2",
     True, 100, "active"),
    ("predictit", "PredictIt", "https://www.predictit.org",
     "https://www.predictit.org/api/marketdata", True, 30, "active"),
    ("manifold", "Manifold Markets", "https://manifold.markets",
     "https://api.manifold.markets/v0", True, 120, "active"),
)

# Risk texts.
RISK_TEXTS = {
    "liquidity": "Low liquidity may cause significant slippage",
    "timing": "Time misalignment increases execution risk",
    "correlation": "Markets may not be perfectly correlated",
    "execution": "Complex execution may fail",
}
MITIGATION_TEXTS = {
    "liquidity": "Reduce position size to minimize market impact",
    "timing": "Execute trades as close to market close as possible",
    "limit_orders": "Use limit orders to control execution prices",
    "monitor": "Monitor positions closely for early exit opportunities",
}
RISK_LEVELS = (("very_low", 0.15), ("low", 0.3), ("medium", 0.5), ("high", 0.7))
RISK_LEVEL_TOP = "very_high"

# Explanation of a score.
EXPLANATION_TEXTS = {
    "score": "ML Score: %.2f - ",
    "text": "High text similarity (%.2f)",
    "price": "Significant price difference (%.3f)",
    "category": "Categories match",
    "closing": "Both markets closing soon",
    "bucket": "High bucket success rate",
    "none": "Low confidence prediction",
}
# Evaluation of a pair without a reply.
FALLBACK_TEXTS = {
    "reasoning": "LLM evaluation failed: {error}. Using fallback heuristics.",
    "risk": "High risk due to LLM evaluation failure",
    "action": "INVESTIGATE",
}

# Confidence bands (label, lower bound), by number of bands.
CONFIDENCE_BANDS = {
    5: (("Very High (0.8-1.0)", 0.8), ("High (0.7-0.8)", 0.7), ("Medium (0.5-0.7)", 0.5),
        ("Low (0.3-0.5)", 0.3), ("Very Low (0.0-0.3)", 0.0)),
    6: (("Excellent (0.9-1.0)", 0.9), ("Very High (0.8-0.9)", 0.8), ("High (0.7-0.8)", 0.7),
        ("Medium (0.5-0.7)", 0.5), ("Low (0.3-0.5)", 0.3), ("Very Low (0.0-0.3)", 0.0)),
    7: (("Excellent (0.9-1.0)", 0.9), ("Very High (0.8-0.9)", 0.8), ("High (0.7-0.8)", 0.7),
        ("Medium (0.5-0.7)", 0.5), ("Low (0.3-0.5)", 0.3), ("Very Low (0.1-0.3)", 0.1),
        ("Minimal (0.0-0.1)", 0.0)),
}

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
                "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy",
                "dd/MM/yyyy")
