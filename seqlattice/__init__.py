"""seqlattice: sequence decoding and transcription-quality analytics on Spark DataFrames."""
