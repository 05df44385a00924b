"""Adapters from the star-schema test tables, registered queries and their SQL."""
