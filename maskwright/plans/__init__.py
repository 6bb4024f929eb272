"""Registered queries of the masking engine."""

from maskwright.plans import catalogue, detectors, profiles, relations, review
from maskwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "detectors", "profiles", "relations", "review"]
