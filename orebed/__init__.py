"""Analytics over industrial series, evidence and text, written as Spark jobs."""
