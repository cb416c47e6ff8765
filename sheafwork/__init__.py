"""sheafwork: document analytics, screening and corpus preparation on Spark DataFrames."""

ENGINE_VERSION = "0.1.0"
