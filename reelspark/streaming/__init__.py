"""Online updates from micro-batches."""
