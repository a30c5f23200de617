"""Program texts: intermediate representation, renderings, opaque renaming, differential runs."""
