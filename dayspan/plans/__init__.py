"""End-to-end plans (stages of the job) and the named query catalogue."""
