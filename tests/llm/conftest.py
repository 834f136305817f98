"""The session comes from the tests above."""
