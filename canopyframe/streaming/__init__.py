"""Structured Streaming: watermarked sensor windows, frame summaries on arrival, late-tolerant alignment."""
