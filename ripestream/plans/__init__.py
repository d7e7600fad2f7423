"""Registered queries over the driver tables (see ``sources.proxy``)."""

from ripestream.plans.registry import REGISTRY, Query, register  # noqa: F401


def load_all() -> dict:
    # Importing the modules fills the registry.
    from ripestream.plans import features, files, joins, labels, messages, models, physics, quality, stats, streams, training  # noqa: F401

    return REGISTRY
