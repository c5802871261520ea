"""Part of tessella; see the modules."""
