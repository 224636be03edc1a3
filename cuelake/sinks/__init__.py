"""cuelake.sinks: transcripts as documents and files."""
