"""Pipelines, robot configurations and the registered queries."""
