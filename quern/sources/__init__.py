"""Readers of audio, images, arrays, model files and configurations."""
