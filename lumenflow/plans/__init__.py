"""Registered queries and their SQL."""

from __future__ import annotations

from . import motion


def flagship(spark, sf_dir):
    return motion.signal_detections(spark, sf_dir)


def queries():
    return {name: f for name, (f, _) in motion.REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in motion.REGISTRY.items() if sql}
