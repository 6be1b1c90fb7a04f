"""Physical-plan helpers, test-table views and the query catalog."""
