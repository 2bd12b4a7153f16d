"""Tables, text catalogs, delimited text in and out."""
