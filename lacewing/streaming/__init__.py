from lacewing.streaming.ingest import keep_edges, streaming_degrees

__all__ = ["keep_edges", "streaming_degrees"]
