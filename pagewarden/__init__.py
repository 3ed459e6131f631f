"""Site-audit analytics over page corpora, as Spark plans."""
