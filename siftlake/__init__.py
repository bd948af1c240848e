"""siftlake: review-intelligence analytics as lazy Spark plans."""
