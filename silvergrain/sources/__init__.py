"""Sources: files, archives, tables of text, mail, plug-in extractors; sinks for events."""
