"""Plan helpers: lineage cuts and fixpoint loops."""
