"""Every registered query with its oracle SQL, grouped by subject."""

from . import change, clinical, cohort, exchange, metrics, reports, volumes

GROUPS = (cohort, clinical, metrics, volumes, change, reports, exchange)


def all_queries() -> dict:
    merged: dict = {}
    for group in GROUPS:
        clash = merged.keys() & group.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        merged.update(group.QUERIES)
    return merged
