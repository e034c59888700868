"""Imports every module of registered queries."""

from jobloom.plans import (  # noqa: F401
    class_scores,
    codes_and_text,
    models,
    sampling,
    streams,
    tasks_and_wages,
    titles,
    vectors,
)
from jobloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
