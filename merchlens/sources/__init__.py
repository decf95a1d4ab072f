"""Readers and writers of products, predictions, parameters, results, images and models."""
