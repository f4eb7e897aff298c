"""Sources and sinks of statement logs."""
