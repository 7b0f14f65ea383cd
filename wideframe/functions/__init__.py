"""Column expressions; nothing here reads data or shuffles."""
