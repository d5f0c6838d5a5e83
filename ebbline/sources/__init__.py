"""Reading, persisting and ingesting the analytics tables."""
