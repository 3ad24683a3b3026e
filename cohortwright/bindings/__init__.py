"""Queries over the driver tables: one per operator, each with the SQL that must give the same rows."""

from . import cohort_folds, evaluation, evidence, keys_joins, metadata_prep, modelling

BOOKS = (keys_joins.book, metadata_prep.book, cohort_folds.book, evaluation.book, evidence.book, modelling.book)
