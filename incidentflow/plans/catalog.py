"""Imports every query module so that all registrations are in place."""

from . import q_clean, q_analytics, q_geo, q_prescribe, q_feedback, q_text, q_learn, q_hulls, q_io  # noqa: F401
from .registry import QUERIES, ORACLE  # noqa: F401
