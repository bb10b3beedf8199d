"""Analytics over source code, security patches, disassembled binaries and text corpora, on Spark."""
