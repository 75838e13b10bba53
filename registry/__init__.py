"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from registry import dense, dictionary, evaluation, files, latent, lexical, sparse

_PARTS = (files, lexical, sparse, evaluation, dense, latent, dictionary)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
