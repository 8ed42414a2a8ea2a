"""kvlume: keyed-log analytics expressed as Spark DataFrame programs."""
