"""Sources and idempotent sinks."""
