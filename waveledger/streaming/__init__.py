"""Window features over an event-time stream."""
