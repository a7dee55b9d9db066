"""Analytics over catalogs of time-stamped, optionally geo-located and tagged records, as Spark DataFrame transformations."""
