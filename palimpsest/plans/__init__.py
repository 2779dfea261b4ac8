"""The engine's queries over the driver's tables."""
