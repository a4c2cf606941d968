"""All core queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import answers, boards, evaluations, games, midgame, more, playing, relational, selection, stored, streams, texts, training

_MODULES = [relational, boards, more, texts, answers, midgame, games, evaluations, playing, selection, stored, streams, training]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
