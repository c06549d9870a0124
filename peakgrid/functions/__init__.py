"""Functions that SQL sessions can call once register() has been run."""

from .registry import register

__all__ = ["register"]
