"""DataFrame transformations over a catalog; every ordered or spatial one is keyed by ``project``."""
