"""Registered queries, by theme; importing a module registers its queries."""

from . import advanced, comparing, evaluation, features, files, flagship, images, modelling, spatial, tabular, texture  # noqa: F401
