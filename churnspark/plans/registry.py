"""All registered queries by name."""

from churnspark.plans import decisions, diagnostics, learning, profiles

ALL = {**diagnostics.QUERIES, **profiles.QUERIES, **decisions.QUERIES, **learning.QUERIES}
