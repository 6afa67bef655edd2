"""Analytics over daily market bars, as DataFrame operators on Spark."""
