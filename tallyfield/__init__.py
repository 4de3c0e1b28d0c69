"""Spark jobs for event-based sports and betting-market data."""
