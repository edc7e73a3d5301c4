"""Jobs to run from the command line, each a function of a session and paths."""
