"""seamline: Spark jobs over image corpora, stitch designs and stitch-file lakes."""
