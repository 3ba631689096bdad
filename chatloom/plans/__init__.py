"""The registered queries: each a plan over the tables, with its SQL beside it."""
