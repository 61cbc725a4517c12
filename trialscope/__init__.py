"""trialscope: agent-trace and trial analytics as Spark DataFrames."""
