"""Lookup tables and constants. They are arguments of the operators, which take other tables of the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must equal those of the pipeline that results are compared with.
TIER_1_OFFICIAL = ["who.int", "cdc.gov", "ecdc.europa.eu", "promedmail.org"]
TIER_1_ACADEMIC = ["nature.com", "thelancet.com", "nejm.org", "science.org", "bmj.com", "pnas.org"]
TIER_2_OFFICIAL = ["nih.gov", "fda.gov", "gov.uk", "fhi.no", "health.gov.au", "phac-aspc.gc.ca"]
TIER_2_ACADEMIC = ["medrxiv.org", "biorxiv.org", "nextstrain.org", "gisaid.org"]
TIER_2_MEDIA = ["reuters.com", "apnews.com"]
AGGREGATORS = ["metaculus.com", "goodjudgment.io", "manifold.markets", "kalshi.com", "infer-pub.com", "polymarket.com"]
TIER_3_MEDIA = ["bbc.com", "bbc.co.uk", "nytimes.com", "washingtonpost.com", "theguardian.com", "statnews.com", "theconversation.com"]
TIER_3_ACADEMIC = ["wikipedia.org", "sciencedirect.com", "pubmed.ncbi.nlm.nih.gov"]
TIER_4_NGO = ["aljazeera.com", "france24.com", "dw.com", "cidrap.umn.edu", "reliefweb.int", "msf.org", "doctorswithoutborders.org", "redcross.org"]
TIER_SCORE = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.4, 5: 0.2}
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src"]
SKIPPED_EXTENSIONS = ["zip", "exe", "msi", "dmg", "tar", "gz", "png", "jpg", "jpeg", "gif", "svg", "mp4", "mp3"]
DASHBOARDS = [
    ("h5n1", "https://www.cdc.gov/bird-flu/situation-summary/"),
    ("h5n1", "https://www.who.int/teams/global-influenza-programme/avian-influenza"),
    ("avian influenza", "https://www.cdc.gov/bird-flu/situation-summary/"),
    ("avian influenza", "https://www.who.int/teams/global-influenza-programme/avian-influenza"),
    ("mpox", "https://ourworldindata.org/mpox"),
    ("mpox", "https://www.who.int/emergencies/situation-reports"),
    ("mpox", "https://www.cdc.gov/mpox/data-research/index.html"),
    ("ebola", "https://www.afro.who.int/health-topics/ebola-virus-disease"),
    ("ebola", "https://www.cdc.gov/ebola/index.html"),
    ("covid-19", "https://ourworldindata.org/coronavirus"),
    ("covid-19", "https://www.who.int/emergencies/diseases/novel-coronavirus-2019/situation-reports"),
    ("marburg", "https://www.who.int/news-room/fact-sheets/detail/marburg-virus-disease"),
    ("marburg", "https://www.cdc.gov/marburg/index.html"),
]
QUESTION_TYPES = {
    "outbreak_count": ["latest_data", "trend", "policy", "historical_analogy"],
    "binary_event": ["latest_data", "trend", "mechanism", "expert_opinion", "historical_analogy"],
    "mechanism_or_attribution": ["mechanism", "expert_opinion", "latest_data"],
    "unknown": ["latest_data", "trend", "mechanism", "policy", "historical_analogy", "expert_opinion"],
}
AXES = QUESTION_TYPES["unknown"]
COUNTRIES = {
    "united states": "US", "usa": "US", "us": "US", "united kingdom": "GB", "uk": "GB", "china": "CN", "india": "IN", "brazil": "BR",
    "uganda": "UG", "democratic republic of the congo": "CD", "drc": "CD", "congo": "CG", "nigeria": "NG", "south africa": "ZA",
    "kenya": "KE", "ethiopia": "ET", "tanzania": "TZ", "egypt": "EG", "australia": "AU", "canada": "CA", "mexico": "MX",
    "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "japan": "JP", "south korea": "KR", "indonesia": "ID",
    "thailand": "TH", "vietnam": "VN", "pakistan": "PK", "bangladesh": "BD", "saudi arabia": "SA", "iran": "IR", "turkey": "TR",
    "russia": "RU", "texas": "US", "california": "US", "iowa": "US",
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERNS = [rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}", rf"(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}"]
# End of the fixed values.


def tier_rows() -> list[tuple[str, int, str]]:
    """(domain, tier, label)."""
    groups = [(1, "official", TIER_1_OFFICIAL), (1, "academic", TIER_1_ACADEMIC), (2, "official", TIER_2_OFFICIAL), (2, "academic", TIER_2_ACADEMIC), (2, "trusted_media", [*TIER_2_MEDIA, *AGGREGATORS]), (3, "trusted_media", TIER_3_MEDIA), (3, "academic", TIER_3_ACADEMIC), (4, "ngo", TIER_4_NGO)]
    return [(d, tier, label) for tier, label, ds in groups for d in ds]


def tier_dim(spark: SparkSession, rows: list[tuple[str, int, str]] | None = None) -> DataFrame:
    return _lookup(spark, rows if rows is not None else tier_rows(), "domain string, tier int, label string")


def dashboard_dim(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = DASHBOARDS if rows is None else rows
    return _lookup(spark, [(k, u, i) for i, (k, u) in enumerate(rows)], "pathogen_key string, url string, dash_ord int")


def _lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants; whether it is small is known from the rows themselves."""
    out = spark.createDataFrame(rows, schema)
    out._evloom_small = sum(40 + sum(len(str(v)) for v in r) for r in rows) <= 16 << 20
    return out
