"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from depweave.catalog import edges, files, graphs, rules, spaces, texts, views

QUERIES = edges.QUERIES | graphs.QUERIES | views.QUERIES | texts.QUERIES | rules.QUERIES | files.QUERIES | spaces.QUERIES
ORACLES = edges.ORACLES | graphs.ORACLES | views.ORACLES | texts.ORACLES | rules.ORACLES | files.ORACLES | spaces.ORACLES
