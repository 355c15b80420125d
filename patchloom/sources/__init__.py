"""Reading and writing of cases, submissions, results and caches."""
