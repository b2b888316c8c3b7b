"""DataFrame operators for streams of public work notices and similar records."""
