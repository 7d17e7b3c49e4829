"""The registered queries: each a DataFrame plan over the driver tables, with its SQL where SQL can say it."""
