"""Scalar business rules as native Column expressions (no Python UDFs)."""

from febrile.functions.rules import *  # noqa: F401,F403
