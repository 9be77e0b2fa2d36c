"""Graph, community and topic operators over DataFrames."""
