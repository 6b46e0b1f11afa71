"""Import every plan module so its queries register."""

from __future__ import annotations

import importlib

MODULES = (
    "kiln.plans.scoring",
    "kiln.plans.cleaning",
    "kiln.plans.mixing",
    "kiln.plans.grading",
    "kiln.plans.curation",
    "kiln.plans.tokens",
    "kiln.plans.streams",
    "kiln.plans.files",
    "kiln.plans.extras",
    "kiln.plans.branches",
)


def load() -> None:
    for m in MODULES:
        importlib.import_module(m)


load()
