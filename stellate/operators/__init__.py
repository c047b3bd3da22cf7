"""Search, index, profile and relational operators over DataFrames."""
