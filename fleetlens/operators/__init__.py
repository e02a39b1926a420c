"""Normalisation steps and fact builders."""
