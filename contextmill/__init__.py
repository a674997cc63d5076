"""contextmill: context budgeting, run analytics and corpus operators as Spark jobs."""
