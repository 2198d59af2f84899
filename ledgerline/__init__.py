"""ledgerline: disclosure analytics expressed as Spark DataFrame plans."""
