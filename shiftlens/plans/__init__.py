from shiftlens.plans import details, joins, motifs, overlays, registry, search, signals, tables  # noqa: F401
