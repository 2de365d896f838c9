"""Registered queries. Each module offers QUERIES: name -> (callable, SQL or None)."""
