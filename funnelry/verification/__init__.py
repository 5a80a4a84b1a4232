"""The registered queries and the plain SQL they are compared with."""
