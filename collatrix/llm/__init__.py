"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

import importlib
from types import ModuleType

#: The modules with operators; each has QUERIES and ORACLE.
MODULES = ("quality", "decontaminate", "toxicity", "mixing", "token_count", "url_filter", "licences", "near_duplicates", "repeats", "lm_score")


def query_modules() -> list[ModuleType]:
    return [importlib.import_module(f"collatrix.llm.{name}") for name in MODULES]
