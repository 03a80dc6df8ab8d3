"""Analytics over fleets of weather stations as Spark DataFrame operators."""
