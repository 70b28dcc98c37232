"""Multi-step jobs that answer a whole question."""
