"""The queries of this subpackage and the SQL that states them where SQL can."""

from __future__ import annotations

from . import chat, decontamination, language, licenses, line_rules, packing, paragraphs, quality, sharding, simhash

MODULES = [sharding, quality, chat, licenses, packing, decontamination, simhash, line_rules, language, paragraphs]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
