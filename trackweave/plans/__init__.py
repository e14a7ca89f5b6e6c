"""Views over the star-schema tables that stand in for a request log, and the registered queries."""
