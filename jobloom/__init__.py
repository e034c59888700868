"""Occupation and text-matching analytics expressed as Spark DataFrame operators."""

from jobloom.session import build_session, cut_lineage, workspace

__all__ = ["build_session", "cut_lineage", "workspace"]
