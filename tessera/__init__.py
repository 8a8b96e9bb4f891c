"""Analytics over hierarchical imaging metadata and tile data, on Spark."""
