"""bookengine: book and web-document corpora as Spark tables."""
