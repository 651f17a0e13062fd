"""Models and media tools: what runs outside the engine, behind partition functions."""
