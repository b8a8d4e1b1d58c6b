"""Runnable queries over the driver's tables, with the SQL that checks them."""

from . import cleaning, features, reports, outlook, exports, assistant, models, streams  # noqa: F401
from .base import ENTRIES  # noqa: F401
