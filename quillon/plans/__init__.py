"""Plan-level helpers: tables, staging, sessions."""
