"""Extract, align and score short text regions at corpus scale with Spark."""
