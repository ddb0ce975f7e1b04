"""The search language: text to a bound tree of conditions. Pure Python, no Spark."""
