"""Registered queries; importing any of these modules registers all of them, in one order."""

from . import registry  # noqa: F401
