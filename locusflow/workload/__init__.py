"""The registered queries: relations derived from the supplied tables, and the operators run on them."""
