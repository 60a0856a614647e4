"""Settings of the matching pipeline."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class MatchConfig:
    """Defaults of retrieval, fusion, scoring and ingestion."""

    k1: float = 1.2
    b: float = 0.75
    query_words: int = 60
    boosts: Mapping[str, float] = field(
        default_factory=lambda: {
            "requirements_tags": 5.0,
            "specializations": 4.0,
            "title": 3.0,
            "technical_skills": 3.0,
            "certificates": 2.5,
            "languages": 2.0,
            "soft_skills": 1.0,
            "job_requirements": 0.5,
            "job_description": 0.3,
        }
    )
    browse_boosts: Mapping[str, float] = field(
        default_factory=lambda: {"title": 4.0, "company": 2.0, "category": 2.0, "job_location": 2.0, "technical_skills": 2.0, "requirements_tags": 1.0, "specializations": 1.0, "job_requirements": 1.0}
    )
    msm: float = 0.2
    msm_relaxed: float = 0.1
    size: int = 80
    scored: int = 30
    relax_below: int = 12
    rrf_k: int = 60
    distance_km: float = 30.0
    location_floor: float = 1.5
    same_city: float = 8.5
    other_city: float = 1.5
    unknown_city: float = 5.0
    weights: Mapping[str, float] = field(default_factory=lambda: {"relevance": 0.25, "skills": 0.30, "experience": 0.15, "education": 0.10, "location": 0.10, "salary": 0.10})
    tail_score: float = 3.0
    fallback_start: float = 5.0
    fallback_step: float = 0.12
    recrawl_days: int = 7
    overview_least: int = 50
    page_least: int = 5000
    page_size: int = 20
    page_size_most: int = 100
    response_cap: int = 50
    log_kept: int = 100
    quota: int = 50
    disagreement: int = 4
    sibling_cap: int = 5
    vector_cap: int = 30
    min_similarity: float = 0.6


CONFIG = MatchConfig()
