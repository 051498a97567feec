"""Evaluation of responses as their files arrive."""
