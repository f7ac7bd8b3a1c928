"""loopscope: event-trace and repetitive-log analytics on Spark DataFrames."""
