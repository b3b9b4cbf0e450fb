"""codemill: code and corpus analytics expressed as Spark DataFrame plans."""
