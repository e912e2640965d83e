from lacewing.plans.propagate import RoundProgram, VertexProgram, edge_map, iterate, push, run_program, run_rounds, vertex_map, vertex_subset

__all__ = ["RoundProgram", "VertexProgram", "edge_map", "iterate", "push", "run_program", "run_rounds", "vertex_map", "vertex_subset"]
