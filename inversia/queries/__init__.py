"""All registered queries, by name."""

from __future__ import annotations

from inversia.queries import features, files, fills, grids, models, quality, site_models
from inversia.queries.views import Query

REGISTRY: dict[str, Query] = {}
for _module in (features, quality, fills, grids, files, models, site_models):
    for _name, _query in _module.QUERIES.items():
        if _name in REGISTRY:
            raise ValueError(f"query {_name} is registered twice")
        REGISTRY[_name] = _query
