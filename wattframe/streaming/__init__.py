from .history import closed_days, feature_stream, history_stream  # noqa: F401
from .rollups import daily_stream, dedup_stream, keep_first_stream, sliding_mean_stream  # noqa: F401
from .sinks import FeatureSink, RollupSink, UpsertSink, latest, run_available  # noqa: F401
