from .layout import detect_layout, prepare_daily, resolve_target  # noqa: F401
from .readers import first_available, parse_lines, read_telemetry  # noqa: F401
from .tables import (  # noqa: F401
    load_model, read_profile, read_run, save_model, write_forecast, write_profile, write_run,
)
