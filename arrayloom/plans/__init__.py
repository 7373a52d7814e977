"""Planning: contraction order and lineage of loops."""
