"""Part of sylvaframe; see README.md."""
