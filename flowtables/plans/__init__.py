"""The registered queries and the attribution program."""
