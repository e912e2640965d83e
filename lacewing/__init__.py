"""lacewing: graph analytics on grammar-compressed graphs, on Spark DataFrames."""

from lacewing.model import CompressedGraph, Graph, GraphMeta
from lacewing.session import build_session

__all__ = ["CompressedGraph", "Graph", "GraphMeta", "build_session"]
