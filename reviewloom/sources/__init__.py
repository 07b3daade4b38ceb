from .cleaning import (
    clean_games,
    clean_reviews,
    judge_games,
    judge_reviews,
    reason_counts,
    write_judged,
)
from .readers import read_games, read_reviews, spread, stream_games, stream_reviews
from .sinks import as_result, save_bucketed, write_buckets, write_copy, write_result

__all__ = [
    "as_result",
    "clean_games",
    "clean_reviews",
    "judge_games",
    "judge_reviews",
    "read_games",
    "read_reviews",
    "reason_counts",
    "save_bucketed",
    "spread",
    "stream_games",
    "stream_reviews",
    "write_buckets",
    "write_copy",
    "write_judged",
    "write_result",
]
