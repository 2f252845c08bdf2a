"""Defaults of every operator, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Results depend on them.
    top_k_dense: int = 40
    top_k_sparse: int = 40
    top_k_final: int = 12
    rrf_k: int = 20
    heading_weight: float = 2.5
    act_affinity_weight: float = 0.10
    title_affinity_weight: float = 0.15
    rerank_cap: int = 12
    min_relevance: float = 0.25
    crossref_limit: int = 6
    crossref_seeds: int = 5
    crossref_score: float = 0.3
    edge_confidence: float = 0.5
    context_tokens: int = 8000
    chunk_target: int = 512
    chunk_max: int = 900
    chunk_overlap: int = 64
    chars_per_token: float = 3.0
    term_cap: int = 60
    exact_limit: int = 12
    history_messages: int = 12
    memory_cap: int = 200
    memory_half_life_weeks: float = 14.0
    memory_min_weight: float = 0.1
    memory_prune_weight: float = 0.05
    topic_cap: int = 20
    quota_anonymous: int = 50
    quota_user: int = 500
    quota_pro: int = 5000
    quota_seconds: int = 86_400
    breaker_failures: int = 3
    breaker_cooldown_s: int = 60
    otp_ttl_s: int = 300
    otp_attempts: int = 5
    otp_cooldown_s: int = 60
    payment_timeout_ms: int = 12 * 3600 * 1000
    subscription_days: int = 30
    price_tiyin: int = 79_000 * 100
    #: Rows of a dimension or a set of queries that may be broadcast.
    broadcast_rows: int = 1_000_000


DEFAULT = Config()
