"""Text functions as expressions."""
