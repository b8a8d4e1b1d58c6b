from . import calendar, numeric, text  # noqa: F401
