"""bandwatch: coverage-aware spectrum-occupancy analytics on Spark."""
