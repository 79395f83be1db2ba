"""The reference has no streaming operators. ``online`` offers greedy search on a stream of targets."""
