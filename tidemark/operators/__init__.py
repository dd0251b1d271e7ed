"""Set-based operators: DataFrame in, DataFrame out."""
