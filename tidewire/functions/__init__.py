"""Column functions of the engine."""

from .columns import *  # noqa: F403
