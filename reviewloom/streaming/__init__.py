from .epochs import (
    Running,
    compact_log,
    epochs_of,
    latest,
    log_view,
    newest_view,
    run_epochs,
    start_log,
    written_view,
)
from .handlers import handle_batches, stateful_handlers
from .keyed import (
    GameCounts,
    compact_top,
    held_games,
    histogram_percentile,
    keyed_counts,
    run_histograms,
    run_percentile,
    run_top,
    running_flags,
    tenant_counts,
    top_view,
)
from .ledger import (
    accept_new_batches,
    completeness,
    first_delivery,
    missing_batches,
    missing_ranges,
    once,
    senders_complete,
)
from .processors import measured_lanes, merged, state_rows, tenant_states
from .purges import drop_tenants, purge_marks, run_purged, with_purges
from .questions import (
    stream_over_threshold,
    stream_percentile_question,
    stream_percentile_ranks,
    stream_platform_counts,
    stream_top_playtime,
    stream_top_reviewed,
    tagged_rows,
)
from .results import first_result, progress, run_first_results, with_finish_rows
from .tenants import drop_done, live_rows, purged_ids, rewrite_without, run_open

__all__ = [
    "GameCounts",
    "Running",
    "accept_new_batches",
    "compact_log",
    "compact_top",
    "completeness",
    "drop_done",
    "drop_tenants",
    "epochs_of",
    "first_delivery",
    "first_result",
    "handle_batches",
    "held_games",
    "histogram_percentile",
    "keyed_counts",
    "latest",
    "live_rows",
    "log_view",
    "measured_lanes",
    "merged",
    "missing_batches",
    "missing_ranges",
    "newest_view",
    "once",
    "progress",
    "purge_marks",
    "purged_ids",
    "rewrite_without",
    "run_epochs",
    "run_first_results",
    "run_histograms",
    "run_open",
    "run_percentile",
    "run_purged",
    "run_top",
    "running_flags",
    "senders_complete",
    "start_log",
    "state_rows",
    "stateful_handlers",
    "stream_over_threshold",
    "stream_percentile_question",
    "stream_percentile_ranks",
    "stream_platform_counts",
    "stream_top_playtime",
    "stream_top_reviewed",
    "tagged_rows",
    "tenant_counts",
    "tenant_states",
    "top_view",
    "with_finish_rows",
    "with_purges",
    "written_view",
]
