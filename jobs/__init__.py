"""Runnable jobs; each module has a command line, a config file of its name beside it, and a ``run`` that takes a session."""
