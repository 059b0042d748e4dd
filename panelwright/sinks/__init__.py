"""Tables that jobs write."""
