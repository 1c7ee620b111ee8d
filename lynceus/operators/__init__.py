"""Part of the lynceus engine."""
