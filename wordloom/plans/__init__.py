from wordloom.plans import (  # noqa: F401
    word_plans,
    interval_plans,
    article_plans,
    retake_plans,
    idea_plans,
    page_plans,
    repair_plans,
    quality_plans,
    frame_plans,
    source_plans,
    trim_plans,
)
from wordloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
