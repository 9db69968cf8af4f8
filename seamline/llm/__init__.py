"""Training-data operators over document and page tables. Nothing else in the library imports this subpackage."""
