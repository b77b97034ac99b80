"""All queries over the synthetic tables, by name, with their DuckDB equivalents."""

from __future__ import annotations

from . import books, judgement, proof, structure, study, texts


def queries() -> dict:
    return study.QUERIES | structure.QUERIES | texts.QUERIES | judgement.QUERIES | proof.QUERIES | books.QUERIES


def oracle_sql() -> dict[str, str]:
    return study.ORACLES | structure.ORACLES | texts.ORACLES | judgement.ORACLES | proof.ORACLES | books.ORACLES
