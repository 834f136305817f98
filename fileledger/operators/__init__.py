"""Operators over inventories and ledgers: DataFrame in, DataFrame out."""
