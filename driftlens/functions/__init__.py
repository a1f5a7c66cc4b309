"""Part of driftlens; see README.md."""
