"""Structure of files: native expressions where they reach, parsers on the workers where not."""
