"""Event streams: envelopes in, idempotent facts out."""
