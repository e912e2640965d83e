from lacewing.operators.grammar import decompress, repair
from lacewing.operators.levels import rule_levels
from lacewing.operators.pruning import filter_rules, filter_rules_decomposed, flatten_rules
from lacewing.operators.ranking import hits, hits_top, pagerank
from lacewing.operators.traversal import bfs, bfs_compressed, cc_directed, sssp, topo_levels, wcc

__all__ = ["bfs", "bfs_compressed", "cc_directed", "decompress", "filter_rules", "filter_rules_decomposed", "flatten_rules", "hits", "hits_top", "pagerank", "repair", "rule_levels", "sssp", "topo_levels", "wcc"]
