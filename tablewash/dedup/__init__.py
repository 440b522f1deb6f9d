"""Record linkage: candidate pairs, comparison, match decision, clusters, resolution."""
