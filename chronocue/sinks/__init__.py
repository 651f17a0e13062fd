"""What the engine writes: rendered reports, captions, plans for the media encoder."""
