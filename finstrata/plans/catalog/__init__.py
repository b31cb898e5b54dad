"""All registered queries; importing a module of this package registers its queries."""

import importlib
import pkgutil

from finstrata.plans.catalog._core import ENTRIES, oracle, run

FLAGSHIP = "his_monthly_label"

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if not _m.startswith("_"):
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ENTRIES", "FLAGSHIP", "oracle", "run"]
