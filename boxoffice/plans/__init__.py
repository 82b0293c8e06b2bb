"""The registered queries: operators applied to the derived booking tables."""
