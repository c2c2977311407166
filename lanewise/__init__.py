"""Marketplace and logistics analytics as PySpark DataFrame operators."""

from lanewise.plans.marketplace import Marketplace

__all__ = ["Marketplace"]
