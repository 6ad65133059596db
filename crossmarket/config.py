"""Threshold objects. Every operator takes one of these, never a bare constant."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NormalizationConfig:
    max_title_length: int = 200
    max_description_length: int = 1000
    min_price: float = 0.0001
    max_price: float = 0.9999
    default_price: float = 0.5
    past_days: int = 365
    future_days: int = 1095
    category_confidence: float = 0.7


@dataclass(frozen=True)
class FilterConfig:
    min_volume: float = 100.0
    valid_price: tuple[float, float] = (0.01, 0.99)
    price_range: tuple[float, float] = (0.05, 0.95)
    min_gap: float = 0.02
    transaction_cost: float = 0.01
    min_similarity: float = 0.3
    title_weight: float = 0.7
    big_gap: float = 0.1
    min_liquidity_score: float = 0.1
    min_volume_ratio: float = 0.1
    max_days: int = 30
    closing_soon_hours: int = 24


@dataclass(frozen=True)
class BucketConfig:
    keyword_cap: float = 50.0
    keyword_scale: float = 80.0
    category_exact: float = 30.0
    category_partial: float = 15.0
    window_end: float = 20.0
    window_start: float = 10.0
    min_score: float = 40.0
    strict_minimum: bool = False
    use_boost: bool = True


# The documented variant: heavier category and window points, accepted only above 60.
DOC_BUCKETS = BucketConfig(category_exact=50.0, window_end=30.0, min_score=60.0,
                           strict_minimum=True, use_boost=False)


@dataclass(frozen=True)
class ScoringConfig:
    prediction_threshold: float = 0.3
    confidence_factor: float = 0.8
    closing_soon_hours: int = 24


@dataclass(frozen=True)
class ModelConfig:
    kind: str = "gradient_boosting"
    trees: int = 100
    depth: int = 6
    step: float = 0.1
    seed: int = 42
    test_share: float = 0.2
    min_rows: int = 100
    positive_confidence: float = 0.8
    folds: int = 5


@dataclass(frozen=True)
class EvaluationConfig:
    screen: float = 0.3
    equivalent: float = 0.7
    accept: float = 0.75
    high: float = 0.9
    batch_size: int = 10
    cache_hours: int = 24


@dataclass(frozen=True)
class ArbitrageConfig:
    min_confidence: float = 0.75
    min_profit_share: float = 0.02
    min_profit_usd: float = 50.0
    max_position: float = 10000.0
    volume_share: float = 0.2
    win_rate: float = 0.8
    kelly_cap: float = 0.25
    kalshi_fee: float = 0.01
    polymarket_fee: float = 0.02
    gas_usd: float = 5.0
    platform_risk: float = 0.1
    deadline_hours: int = 24
    max_risk: str = "medium"
    risk_gate: str = "ordinal"
    risk_weights: tuple[float, ...] = (0.3, 0.25, 0.2, 0.15, 0.1)


@dataclass(frozen=True)
class EnrichmentConfig:
    min_points: int = 5
    price_points: int = 7
    recent_points: int = 5


@dataclass(frozen=True)
class StreamConfig:
    watermark: str = "10 minutes"
    trigger: str = "5 seconds"
    max_offsets: int = 100_000
    high_profit: float = 0.1
    critical_profit: float = 0.2
    price_change: float = 0.05
    slow_seconds: float = 300.0
    low_success: float = 0.9
    error_rate: float = 0.1
    topics: dict[str, str] = field(default_factory=lambda: {
        "market_update": "market-updates",
        "arbitrage_opportunity": "arbitrage-opportunities",
        "pipeline_metrics": "pipeline-metrics",
        "alert": "alerts",
    })


@dataclass(frozen=True)
class RunConfig:
    """Everything one funnel run needs."""

    normalization: NormalizationConfig = NormalizationConfig()
    buckets: BucketConfig = BucketConfig()
    filters: FilterConfig = FilterConfig()
    scoring: ScoringConfig = ScoringConfig()
    evaluation: EvaluationConfig = EvaluationConfig()
    arbitrage: ArbitrageConfig = ArbitrageConfig()
    enrichment: EnrichmentConfig = EnrichmentConfig()
