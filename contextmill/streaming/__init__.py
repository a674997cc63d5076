"""The state operators over streams; each gives the rows of its batch form in ``contextmill.operators.state``."""
