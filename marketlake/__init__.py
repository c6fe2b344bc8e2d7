"""Market-price and market-news jobs on Spark."""
