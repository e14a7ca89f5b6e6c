"""Log sources and message sinks."""
