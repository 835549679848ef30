"""Parameters of the batch jobs, grouped as the jobs use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


# The defaults below are the published defaults of the job being
# rebuilt; results only match with the same numbers.
@dataclass(frozen=True)
class CatalogFilters:
    max_year: int | None = 2020
    min_popularity_quantile: float = 0.30
    min_avg_rating: float = 5.0
    override_min_ratings: int = 10_000
    override_owned_quantile: float = 0.95
    max_required_players: int = 6
    max_playing_time: int = 210


@dataclass(frozen=True)
class Tokenization:
    unify_synonyms: bool = True
    remove_stopwords: bool = True
    ngram_range: tuple[int, int] = (1, 2)


@dataclass(frozen=True)
class FeatureWeights:
    description: float = 1.0
    mechanics: float = 0.8
    categories: float = 0.8
    themes: float = 0.6
    numeric: float = 0.7


@dataclass(frozen=True)
class FeatureColumns:
    text: Sequence[str] = ("description",)
    categorical: Sequence[str] = ("mechanics", "categories", "themes")
    numeric: Sequence[str] = (
        "min_players",
        "max_players",
        "complexity",
        "age_recommendation",
        "num_user_ratings",
        "year_published",
        "playing_time_minutes",
    )
    weights: FeatureWeights = field(default_factory=FeatureWeights)


@dataclass(frozen=True)
class TextVectorization:
    min_df: int = 3
    max_df: float = 0.90
    l2: bool = True
    sublinear: bool = True


@dataclass(frozen=True)
class EmbeddingModel:
    dimensions: int = 250
    normalize: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Preferences:
    """How liked items become preference vectors and scores."""

    aggregation: str = "mean"
    min_samples: int = 2
    dynamic: bool = True
    scaling: float = 0.5
    seed: int = 42

    def __post_init__(self) -> None:
        if (self.aggregation or "").strip().lower() not in ("max", "mean"):
            raise ValueError("aggregation must be 'max' or 'mean'")


OFFLINE_PRESET = Preferences(aggregation="max", min_samples=3, scaling=0.3)
SERVICE_PRESET = Preferences(aggregation="mean", min_samples=2, scaling=0.5)
# One centroid per user, whatever the number of liked items.
SINGLE_CENTROID = Preferences(aggregation="mean", min_samples=2**31 - 1)


@dataclass(frozen=True)
class Preprocessing:
    filters: CatalogFilters = field(default_factory=CatalogFilters)
    features: FeatureColumns = field(default_factory=FeatureColumns)
    tokenization: Tokenization = field(default_factory=Tokenization)
    stopwords: Sequence[str] = ()
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)
