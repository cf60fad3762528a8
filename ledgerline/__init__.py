"""Financial reconciliation and operations analytics as Spark DataFrame operators."""
from ledgerline.settings import Settings

__all__ = ["Settings"]
