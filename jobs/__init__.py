"""Runnable jobs on the library's operators. Each has a command line, a small config file and a function that takes a
session: ``python -m jobs.passage_feed --help``."""
