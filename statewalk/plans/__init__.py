"""Stage definitions, the registered queries and their SQL counterparts."""
