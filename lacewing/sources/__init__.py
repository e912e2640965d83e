from lacewing.sources.readers import load_graph, read_adjacency, read_binary, read_compressed_csr, read_csr, read_edge_list, read_matrix_market, read_separated
from lacewing.sources.writers import load_compressed, save_compressed, write_adjacency, write_csr, write_degree, write_edge_list, write_info, write_matrix_market, write_order

__all__ = ["load_compressed", "load_graph", "read_adjacency", "read_binary", "read_compressed_csr", "read_csr", "read_edge_list", "read_matrix_market", "read_separated", "save_compressed", "write_adjacency", "write_csr", "write_degree", "write_edge_list", "write_info", "write_matrix_market", "write_order"]
