"""A stand-in for podio in tests."""
