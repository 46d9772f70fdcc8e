"""SQL of the registered queries."""

from . import queries  # noqa: F401
from .registry import ORACLES  # noqa: F401
