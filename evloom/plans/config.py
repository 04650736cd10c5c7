"""Parameters of the stages. Defaults are fixed values: results are compared with a pipeline that has these."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class SearchConfig:
    results_per_query: int = 10
    results_cap: int = 60
    most_sub_queries: int = 8
    least_sub_queries: int = 3
    cache_hours: int = 24


@dataclass(frozen=True)
class FilterConfig:
    blocked_domains: tuple = ("facebook.com", "instagram.com", "tiktok.com", "pinterest.com")
    low_value_url: tuple = ("/login", "/signup", "/register", "/account", "/privacy", "/terms", "/contact", "/about", "/careers", "/advertise")
    low_value_title: tuple = ("sign in", "login", "register", "cookie policy", "privacy policy", "terms of use")
    tier_scores: dict = field(default_factory=lambda: {"official": 1.0, "academic": 0.9, "trusted_media": 0.65, "ngo": 0.6, "unknown": 0.35})
    weights: dict = field(default_factory=lambda: {"keyword_overlap": 0.40, "freshness": 0.20, "domain": 0.20, "official_bonus": 0.20})
    keep: float = 0.72
    borderline: float = 0.45
    rerank_weights: tuple = (0.6, 0.4)
    auto_keep: float = 0.82
    auto_reject: float = 0.30
    most_candidates: int = 10
    per_domain: int = 2
    per_type: int = 5
    near_duplicate: float = 0.92


@dataclass(frozen=True)
class ExtractConfig:
    timeout_s: int = 30
    most_bytes: int = 25_000_000
    most_pages: int = 100
    target_tokens: int = 800
    most_tokens: int = 1500


@dataclass(frozen=True)
class InsightConfig:
    top_k: int = 12
    bm25_weight: float = 0.5
    embedding_weight: float = 0.5
    most_input_tokens: int = 500_000
    chunks_per_document: int = 12
    keyword_boost: float = 0.1


def from_dict(kind, values: dict):
    """A config of the kind; unknown keys are ignored."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in known})
