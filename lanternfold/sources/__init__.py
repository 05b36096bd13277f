"""Page sources and the tables the engine writes."""
