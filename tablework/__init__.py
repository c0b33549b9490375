"""tablework: everyday table work (reconcile, clean, reshape, price, profile, retrieve) on Spark."""

__version__ = "0.1.0"
