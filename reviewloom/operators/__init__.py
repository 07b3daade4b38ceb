from .aggregates import (
    count_flags,
    latest_names,
    observed_counts,
    review_counts,
    stage_counts,
    watched,
)
from .comparisons import agreement, compare_ordered, compare_unordered, paired
from .filters import (
    by_decade,
    by_genre,
    by_key,
    by_polarity,
    complete_rows,
    is_polarity,
    non_empty,
    only_if,
    over_count,
    playtime_stat,
)
from .joins import (
    for_listed,
    game_review_counts,
    game_review_counts_by_union,
    named_counts,
    only_listed,
    prefilter,
    without_listed,
)
from .language import classify, confusion, fit_profiles, gram_counts
from .positions import running_total
from .ranking import ascending, percentile_cut, top_n
from .routing import bucket_counts, co_located, route, route_counts, routed
from .sampling import chunk_head, reduced_games, reduced_reviews
from .unions import renumber, union_partitions

__all__ = [
    "agreement",
    "ascending",
    "bucket_counts",
    "by_decade",
    "by_genre",
    "by_key",
    "by_polarity",
    "chunk_head",
    "classify",
    "co_located",
    "compare_ordered",
    "compare_unordered",
    "complete_rows",
    "confusion",
    "count_flags",
    "fit_profiles",
    "for_listed",
    "game_review_counts",
    "game_review_counts_by_union",
    "gram_counts",
    "is_polarity",
    "latest_names",
    "named_counts",
    "non_empty",
    "observed_counts",
    "only_if",
    "only_listed",
    "over_count",
    "paired",
    "percentile_cut",
    "playtime_stat",
    "prefilter",
    "reduced_games",
    "reduced_reviews",
    "renumber",
    "review_counts",
    "route",
    "route_counts",
    "routed",
    "running_total",
    "stage_counts",
    "top_n",
    "union_partitions",
    "watched",
    "without_listed",
]
