"""Files and catalogs."""
