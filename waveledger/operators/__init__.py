"""DataFrame -> DataFrame operators, grouped by the job they belong to."""
