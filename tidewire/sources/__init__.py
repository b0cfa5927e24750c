"""Sources of frames, messages and configuration."""

from .frames import *  # noqa: F403
