"""The test tables as a dataset, and the user-facing views."""
