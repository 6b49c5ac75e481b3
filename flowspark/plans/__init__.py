"""Registered queries. Importing this package registers all of them."""

from . import audits, decisions, encoding, files, models, profiles, serving, splits
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "decisions", "encoding", "files", "models", "profiles", "serving", "splits"]
