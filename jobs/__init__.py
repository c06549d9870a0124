"""Runnable jobs over the library's operators. Each has a command line, a settings file beside it, and a function that takes a session."""
