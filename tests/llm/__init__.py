"""Tests of the training-data operators."""
