"""Multi-job plans: shared tables, connected groups, iterative graph jobs."""
