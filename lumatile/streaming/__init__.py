"""Fields of view as they come in."""
