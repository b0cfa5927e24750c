"""The engine on live input: the same operators, with state that Spark keeps."""

from .stateful import *  # noqa: F403
