"""inferframe: parameterised prompts, page pipelines and text analysis as Spark DataFrames."""
