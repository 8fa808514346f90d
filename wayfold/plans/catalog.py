"""Collects the core queries: importing this module fills the register."""

from . import analytics, pipeline, relational, stateful  # noqa: F401
from .registry import core

__all__ = ["core"]
