"""Evidence retrieval and fact analytics as DataFrame transformations."""
