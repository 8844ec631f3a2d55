"""Training-data operators. Nothing else in bookengine imports this subpackage."""
