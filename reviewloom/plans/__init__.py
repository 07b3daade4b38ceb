from .questions import (
    over_threshold,
    percentile_question,
    platform_counts,
    top_playtime,
    top_reviewed,
)
from .together import all_answers, write_answers

__all__ = [
    "all_answers",
    "over_threshold",
    "percentile_question",
    "platform_counts",
    "top_playtime",
    "top_reviewed",
    "write_answers",
]
