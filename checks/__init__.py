"""Registry of checkable queries and their SQL counterparts."""
