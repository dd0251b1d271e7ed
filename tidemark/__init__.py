"""Event-time user features on Spark: contracts, sliding windows, a guarded feature store, and their monitoring.

The functions that run in Python workers travel by value: executors need the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

from tidemark.operators.contracts import (
    candidate_issues, compat_gate, compat_issues, compat_levels, contract_changes, contract_diff, contract_fields,
    is_compatible, newest_contracts, register,
)
from tidemark.operators.decode import decode_events, decode_messages, decode_rejects, encode_events, split_frames
from tidemark.operators.monitor import (
    capacity, flatten_progress, health, kpi_report, latest_progress, stats_report, throughput_history, throughput_report,
)
from tidemark.operators.profiles import latest_profile
from tidemark.operators.expiry import fold_with_expiry, mark_lives
from tidemark.operators.serving import (
    benchmark_latency, hit_rate, lookup, lookup_batch, sample_users, serving_latency,
)
from tidemark.operators.store import (
    compact, feature_vectors, fold_log, live_users, log_vectors, mark_accepted, to_log, to_long,
)
from tidemark.operators.validate import check_records, dead_letters, letter_reasons, recent_letters, valid_events
from tidemark.operators.windows import select_current_windows, windowed_features
from tidemark.sources.contracts import contracts_table, packaged_schemas, schema_files, writer_schemas
from tidemark.sources.events import event_source, written_events
from tidemark.sources.feature_store import FeatureStore
from tidemark.streaming.jobs import start_features, start_ingest, start_publish, supervise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("cloudpickle", "sys")]
