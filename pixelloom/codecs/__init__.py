"""Decoders and encoders of image files, written from the public format descriptions.

Each works on one file's bytes in memory; the sources apply them to rows in Arrow batches.
"""
