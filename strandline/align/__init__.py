"""Alignment of reads to a reference: options, kernels, chains, regions, pairs, ALT projection, methylation, records, and the whole flow."""
