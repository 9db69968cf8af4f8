"""Readers: stitch files and images as tables."""

from seamline.operators.encoding import decode_pes, read_pes
from seamline.operators.raster import read_images
from seamline.sources.pes import read_designs, write_designs

__all__ = ["decode_pes", "read_designs", "read_images", "read_pes", "write_designs"]
