"""The registered queries and the independent SQL each is checked against."""
