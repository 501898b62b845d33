from lumenlake.plans import catalogue, changes, media, streams, upkeep  # noqa: F401  each registers its queries
