"""Sources and sinks of documents."""
