"""Where the engine reads from."""
