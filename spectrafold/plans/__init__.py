"""Registered queries; importing this package registers all of them."""

from spectrafold.plans import analytics, evaluation, fits, graphs, inference, networks, partners, planning, rollups, scores, screens, selection, state, storage, tabular, vectors  # noqa: F401
