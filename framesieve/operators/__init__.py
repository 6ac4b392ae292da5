"""DataFrame to DataFrame operators on frames, stars, pixels and header maps."""
