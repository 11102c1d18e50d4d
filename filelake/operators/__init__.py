"""DataFrame -> DataFrame operators: each verb returns a lazy plan table and
a one-row summary."""
